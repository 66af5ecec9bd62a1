"""Event logs over the test tables: orders, users, and a user log with injected faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.checks import interleaved


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
COLUMNS = ["stream_id", "model_id", "event_type", "event_number", "global_position", "created_on", "amount", "quantity", "customer_id", "part_id"]


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream an order: OrderCreated, LineAdded for each line, OrderConfirmed or OrderAbandoned, refunds.

    Money is DECIMAL(18,2) before any arithmetic. One exchange by order key serves the line
    numbers, the counts and the join.
    """
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), "o_orderdate"
    )
    w = Window.partitionBy("l_orderkey")
    lines = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_shipdate", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("long").alias("quantity"),
        F.row_number().over(w.orderBy(*LINE_ORDER)).alias("n"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).over(w.orderBy(*LINE_ORDER).rowsBetween(Window.unboundedPreceding, 0)).alias("r"),
    )
    listed = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct("n", "r", "l_returnflag", "l_partkey", "price", "quantity", "l_shipdate")).alias("lines"))
    joined = orders.join(listed, orders["o_orderkey"] == listed["k"], "left")
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    none = {"amount": "decimal(18,2)", "quantity": "bigint", "customer_id": "bigint", "part_id": "bigint"}

    def event(kind, number, at, **data):
        return F.struct(F.lit(kind).alias("event_type"), number.cast("long").alias("event_number"), at.cast("timestamp_ntz").alias("created_on"), *[data.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    created = event("OrderCreated", F.lit(0), F.col("o_orderdate"), amount=F.col("total"), customer_id=F.col("o_custkey"))
    added = F.transform("lines", lambda x: event("LineAdded", x["n"], x["l_shipdate"], amount=x["price"], quantity=x["quantity"], part_id=x["l_partkey"]))
    end = F.when(F.col("o_orderstatus") == "F", "OrderConfirmed").when(F.col("o_orderstatus") == "O", "OrderAbandoned")
    ended = event("", n_lines + 1, F.col("o_orderdate")).withField("event_type", end)
    back = F.transform(F.filter("lines", lambda x: (F.col("o_orderstatus") == "F") & (x["l_returnflag"] == "R")), lambda x: event("RefundAppliedToOrder", n_lines + 1 + x["r"], x["l_shipdate"], amount=x["price"], part_id=x["l_partkey"]))
    kind = joined.select(F.array(created).alias("e")).schema["e"].dataType.simpleString()
    empty = F.array().cast(kind)
    events = F.concat(F.array(created).cast(kind), F.coalesce(added.cast(kind), empty), F.when(end.isNotNull(), F.array(ended).cast(kind)).otherwise(empty), F.coalesce(back.cast(kind), empty))
    rows = joined.select(F.col("o_orderkey").alias("model_id"), F.explode(events).alias("e")).select("model_id", "e.*")
    return rows.withColumns({"stream_id": F.concat(F.lit("order-"), F.col("model_id").cast("string")), "global_position": interleaved(F.col("event_number"), F.col("model_id"))}).select(*COLUMNS)


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream a user, numbered in the order of the events."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream_id"), F.col("user_id").alias("model_id"), "event_type", n.cast("long").alias("event_number"),
        F.col("event_id").alias("global_position"), F.col("ts").alias("created_on"), F.col("props").alias("payload"), F.col("value").cast("decimal(18,2)").alias("amount"),
    )


def faulty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user log with faults by position: every 23rd lost, every 17th twice, some unknown, corrupt or with a mark."""
    p = F.col("global_position")
    log = user_log(spark, sf_dir).where(p % 23 != 0)
    twice = F.when(p % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    log = log.withColumn("copy", F.explode(twice))
    payload = F.when(p % 31 == 0, F.lit("{bad")).when(p % 37 == 0, F.concat(F.lit("﻿"), "payload")).otherwise(F.col("payload"))
    kind = F.when(p % 29 == 0, F.lit("mystery")).otherwise(F.col("event_type"))
    return log.withColumns({"payload": payload, "event_type": kind, "global_position": p * 2 + F.col("copy")}).drop("copy")


def topic_records(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """The events as records of a topic: key, value, headers and time, offsets dense in each partition."""
    rows = _read(spark, sf_dir, "events").withColumn("partition", (F.col("user_id") % partitions).cast("int"))
    offset = F.row_number().over(Window.partitionBy("partition").orderBy("event_id")) - 1
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    head = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value"))
    headers = F.array(head("Event-Type", F.lit("stale")), head("event-type", F.col("event_type")), head("event-number", n), head("created-on", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return rows.select(
        F.lit("user-events").alias("topic"), "partition", offset.cast("long").alias("offset"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"),
        headers.alias("headers"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("seq"),
    )


def read_files(spark: SparkSession, path: str, schema: str, stream: bool = False, after: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """An append-only log of Parquet files, as a batch or a stream, from a position on."""
    reader = (spark.readStream if stream else spark.read).schema(schema)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    log = reader.parquet(path)
    return log if after is None else log.where(F.col("global_position") > after)
