"""Checks of a log and of a read model against it: replay, sequence, lag, drain, reports, generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import KEY, NUMBER, POSITION, TYPE


def normalised(df: DataFrame, columns: Sequence[str]) -> Column:
    """Struct of the columns as they are compared: decimals to two places, times to microseconds, arrays in order."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        v = F.col(c)
        if isinstance(kind, T.DecimalType):
            v = F.round(v, 2)
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            v = F.date_trunc("microsecond", v)
        elif isinstance(kind, T.ArrayType):
            v = F.array_sort(v)
        out.append(v.alias(c))
    return F.struct(*out)


def replay(refolded: DataFrame, stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(model_id, outcome) of each model in either: consistent, different, missing (not stored), extra (not in the log)."""
    a = refolded.select(F.col(KEY), normalised(refolded, columns).alias("want"), F.lit(True).alias("_a"))
    b = stored.select(F.col(KEY), normalised(stored, columns).alias("have"), F.lit(True).alias("_b"))
    both = a.join(b, KEY, "full_outer")
    outcome = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("want").eqNullSafe(F.col("have")), "consistent").otherwise("different")
    return both.select(KEY, outcome.alias("outcome"))


def missing(expected: DataFrame, stored: DataFrame, most: int = 50) -> DataFrame:
    """The first ids that are expected and not stored; a report of `most`."""
    return expected.select(KEY).distinct().join(stored.select(KEY), KEY, "left_anti").orderBy(KEY).limit(most)


def log_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("events"), F.countDistinct("stream_id").alias("streams"), F.max(POSITION).alias("last_position"))


def by_type(log: DataFrame) -> DataFrame:
    return log.groupBy(TYPE).agg(F.count("*").alias("events"), F.countDistinct(KEY).alias("models"))


def sequence_errors(log: DataFrame) -> DataFrame:
    """(model_id, events, in_order): whether a stream's numbers are 0, 1, ... in the order of the log."""
    w = Window.partitionBy(KEY).orderBy(POSITION)
    step = F.col(NUMBER) == F.row_number().over(w) - 1
    return log.select(KEY, step.alias("ok")).groupBy(KEY).agg(F.count("*").alias("events"), F.min("ok").alias("in_order"))


def drained(last_seen: int | None, last_flushed: int | None, stored: int, expected: int) -> bool:
    """Whether all that was seen is flushed and stored."""
    return last_seen == last_flushed and stored == expected


def generate_orders(spark: SparkSession, orders: int, seed: int = 7331, abandon: float = 0.2, refund: float = 0.1) -> DataFrame:
    """A deterministic order log: created, fees, confirmed or abandoned, and for some confirmed ones a refund of 1.00."""
    def draw(salt: int) -> Column:
        """A number from 0 to 1 by MD5, which any engine can draw again."""
        text = F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("id")).cast("binary"))
        return F.conv(F.substring(text, 1, 6), 16, 10).cast("long") / float(1 << 24)

    base = spark.range(orders).withColumns({"_end": F.when(draw(1) < abandon, "OrderAbandoned").otherwise("OrderConfirmed"), "_back": draw(2) < refund})
    kinds = F.array(F.lit("OrderCreated"), F.lit("OrderFeesCalculated"), F.col("_end"))
    kinds = F.when((F.col("_end") == "OrderConfirmed") & F.col("_back"), F.concat(kinds, F.array(F.lit("RefundAppliedToOrder")))).otherwise(kinds)
    rows = base.select(F.col("id").alias(KEY), F.posexplode(kinds).alias("n", TYPE))
    amount = F.when(F.col(TYPE) == "RefundAppliedToOrder", F.lit(1.0)).otherwise(F.round(F.pmod(F.xxhash64(F.lit(seed), KEY), F.lit(100_000)) / 100, 2)).cast("decimal(18,2)")
    return rows.select(
        F.concat(F.lit("order-"), F.col(KEY).cast("string")).alias("stream_id"), KEY, TYPE, F.col("n").cast("long").alias(NUMBER),
        interleaved(F.col("n"), F.col(KEY)).alias(POSITION), amount.alias("amount"),
    )


def interleaved(number: Column, key: Column) -> Column:
    """Sortable position that deals events breadth first over the streams: by number, then by key."""
    return number.cast("long") * F.lit(1 << 40) + key.cast("long")


def report(log: DataFrame) -> DataFrame:
    """Counts of a generated log: events, models, complete, confirmed, abandoned and refunded ones."""
    per = log.groupBy(KEY).agg(F.count("*").alias("n"), *[F.max(F.col(TYPE) == t).alias(c) for c, t in (("c", "OrderConfirmed"), ("a", "OrderAbandoned"), ("r", "RefundAppliedToOrder"))])
    return per.agg(F.sum("n").alias("events"), F.count("*").alias("models"), F.count_if(F.col("c") | F.col("a")).alias("complete"), F.count_if("c").alias("confirmed"), F.count_if("a").alias("abandoned"), F.count_if("r").alias("refunded"))
