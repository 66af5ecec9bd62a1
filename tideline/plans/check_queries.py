"""Queries of checks: replay, missing models, log statistics, reports, sequences, interleaving."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..sources import logs
from . import sql
from .base import query
from .fold_queries import ORDER, order_model


@query(
    "replay_consistency",
    f"""WITH m AS ({sql.ORDER_MODEL}) SELECT CASE WHEN model_id % 97 = 0 THEN 'missing' WHEN model_id % 89 = 0 THEN 'different' ELSE 'consistent' END AS outcome, count(*) AS models FROM m GROUP BY 1""",
)
def replay_consistency(spark, sf_dir):
    """The refolded model against a stored one in which some rows are lost and some changed."""
    model = order_model(spark, sf_dir)
    stored = model.where("model_id % 97 <> 0").withColumn("line_count", F.when(F.col("model_id") % 89 == 0, F.col("line_count") + 1).otherwise(F.col("line_count")))
    return checks.replay(model, stored, ["event_number", *ORDER.fields]).groupBy("outcome").agg(F.count("*").alias("models"))


@query(
    "snapshot_normalise",
    """SELECT o_orderkey, (CAST(round(CAST(o_totalprice * (o_orderkey % 7 - 3) AS DECIMAL(18,3)), 2) AS DECIMAL(18,2)))::DOUBLE AS total, o_orderdate AS "at" FROM orders""",
)
def snapshot_normalise(spark, sf_dir):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") * (k % 7 - 3)).cast("decimal(18,3)").alias("total"), F.col("o_orderdate").alias("at"))
    return o.select("o_orderkey", checks.normalised(o, ["total", "at"]).alias("n")).select("o_orderkey", F.col("n.total").cast("double").alias("total"), F.col("n.at").cast("timestamp_ntz").alias("at"))


@query("missing_models_sample", f"WITH {sql.USERS} SELECT DISTINCT model_id FROM ulog WHERE model_id % 2 = 0 ORDER BY model_id LIMIT 50")
def missing_models_sample(spark, sf_dir):
    log = logs.user_log(spark, sf_dir)
    return checks.missing(log, log.where("model_id % 2 = 1"))


@query("log_scan_stats", f"WITH {sql.ORDERS} SELECT count(*) AS events, count(DISTINCT stream_id) AS streams, max(global_position)::BIGINT AS last_position FROM olog")
def log_scan_stats(spark, sf_dir):
    return checks.log_stats(logs.order_log(spark, sf_dir))


@query("generation_report", f"WITH {sql.ORDERS} SELECT event_type, count(*) AS events, count(DISTINCT model_id) AS models FROM olog GROUP BY event_type")
def generation_report(spark, sf_dir):
    return checks.by_type(logs.order_log(spark, sf_dir))


@query(
    "generation_totals",
    f"""WITH {sql.ORDERS}, p AS (SELECT model_id, count(*) AS n, bool_or(event_type = 'OrderConfirmed') AS c, bool_or(event_type = 'OrderAbandoned') AS a, bool_or(event_type = 'RefundAppliedToOrder') AS r FROM olog GROUP BY model_id)
    SELECT sum(n)::BIGINT AS events, count(*) AS models, count_if(c OR a)::BIGINT AS complete, count_if(c)::BIGINT AS confirmed, count_if(a)::BIGINT AS abandoned, count_if(r)::BIGINT AS refunded FROM p""",
)
def generation_totals(spark, sf_dir):
    return checks.report(logs.order_log(spark, sf_dir))


@query(
    "sequence_validation",
    f"""WITH {sql.FAULTY}, s AS (SELECT model_id, event_number = row_number() OVER (PARTITION BY model_id ORDER BY global_position) - 1 AS ok FROM flog) SELECT model_id, count(*) AS events, bool_and(ok) AS in_order FROM s GROUP BY model_id""",
)
def sequence_validation(spark, sf_dir):
    return checks.sequence_errors(logs.faulty_log(spark, sf_dir))


@query("interleave_order", f"WITH {sql.ORDERS} SELECT stream_id, event_number, event_number * 1099511627776 + model_id AS global_position FROM olog")
def interleave_order(spark, sf_dir):
    return logs.order_log(spark, sf_dir).select("stream_id", "event_number", "global_position")


@query("drain_check", f"WITH {sql.ORDERS} SELECT count(DISTINCT model_id) AS stored, max(global_position)::BIGINT AS last_position, TRUE AS drained FROM olog")
def drain_check(spark, sf_dir):
    log, model = logs.order_log(spark, sf_dir), order_model(spark, sf_dir)
    seen = log.agg(F.countDistinct("model_id").alias("expected"), F.max("global_position").alias("last_position"))
    kept = model.agg(F.count("*").alias("stored"), F.max("global_position").alias("flushed"))
    both = seen.withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one")
    return both.select("stored", "last_position", ((F.col("stored") == F.col("expected")) & F.col("flushed").eqNullSafe(F.col("last_position"))).alias("drained"))


_DRAW = "('0x' || substr(md5('7331:{}:' || id), 1, 6))::BIGINT / 16777216.0"


@query(
    "generated_orders_report",
    f"""WITH d AS (SELECT id, {_DRAW.format(1)} < 0.2 AS a, {_DRAW.format(2)} < 0.1 AS r FROM range(25000) AS t(id))
    SELECT sum(3 + (NOT a AND r)::INT)::BIGINT AS events, count(*) AS models, count(*) AS complete, count_if(NOT a)::BIGINT AS confirmed, count_if(a)::BIGINT AS abandoned, count_if(NOT a AND r)::BIGINT AS refunded FROM d""",
)
def generated_orders_report(spark, sf_dir):
    """A generated log's totals; it reads no table, as the log is made from a seed."""
    return checks.report(checks.generate_orders(spark, 25_000))
