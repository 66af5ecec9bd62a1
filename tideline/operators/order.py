"""Version checks, initial events, deletes and gaps as windows over each key's log.

For the rows of a key in the order of the log, let m be the largest number before a row (the
stored number, or -1, before the first). `monotonic` applies a row above m; `consecutive`
applies m + 1, skips what is not above m, and stops the key at the first larger number.
Skipped rows never raise the maximum, so the window is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY, NUMBER, POSITION, TYPE = "model_id", "event_number", "global_position", "event_type"


def verdicts(log: DataFrame, check: str = "consecutive", initial: str | None = None, deletes: Sequence[str] = (), stored: DataFrame | None = None) -> DataFrame:
    """The log with a `verdict` for each row.

    applied, stale (not above the last number), gap (the first number that skips one),
    faulted (after a gap, or of a stored model that is faulted), state_not_found (no stored
    model and no initial event yet, or after a delete).

    `stored` has model_id, event_number (null: unchecked) and has_faulted of stored models; a row
    whose is_deleted is true, if there is that column, is a key that has ended at its global_position:
    nothing more is applied to it, and events up to there are stale.
    """
    whole = Window.partitionBy(KEY)
    before = whole.orderBy(POSITION).rowsBetween(Window.unboundedPreceding, -1)
    n, at = F.col(NUMBER), F.col(POSITION)
    if stored is None:
        rows = log.withColumns({"_has": F.lit(False), "_stored": F.lit(-1).cast("long"), "_bad": F.lit(False), "_ended": F.lit(None).cast("string")})
    else:
        ended = F.when(F.col("is_deleted"), F.col(POSITION).cast("string")) if "is_deleted" in stored.columns else F.lit(None).cast("string")
        s = stored.select(
            F.col(KEY).alias("_key"), F.col(NUMBER).alias("_stored"), F.coalesce("has_faulted", F.lit(False)).alias("_bad"), F.lit(True).alias("_has"), ended.alias("_ended")
        )
        rows = log.join(s, log[KEY] == s["_key"], "left").drop("_key")
        rows = rows.withColumns({"_stored": F.when(F.col("_has").isNull(), F.lit(-1).cast("long")).otherwise(F.col("_stored")), "_has": F.coalesce("_has", F.lit(False)), "_bad": F.coalesce("_bad", F.lit(False))})
    if initial is None:
        scoped = rows.withColumn("_in", F.lit(True))
    else:
        first = F.min(F.when(F.col(TYPE) == initial, at)).over(whole)
        scoped = rows.withColumn("_in", F.col("_has") | F.coalesce(at >= first, F.lit(False)))
    last = F.max(F.when(F.col("_in"), n)).over(before)
    # With an unchecked stored number the first row is applied whatever its number.
    m = F.coalesce(F.greatest(last, F.coalesce("_stored", last)), F.col("_stored"))
    scoped = scoped.withColumn("_last", m)
    if check == "disabled":
        step = F.lit("applied")
    elif check == "monotonic":
        step = F.when(F.col("_last").isNull() | (n > F.col("_last")), "applied").otherwise("stale")
    elif check == "consecutive":
        step = F.when(F.col("_last").isNull(), "applied").when(n <= F.col("_last"), "stale").when(n == F.col("_last") + 1, "applied").otherwise("gap")
    else:
        raise ValueError(f"unknown version check {check!r}")
    step = F.when(F.col("_bad"), "faulted").when(~F.col("_in"), "state_not_found").otherwise(step)
    out = scoped.withColumn("verdict", step)
    if check == "consecutive":
        gap = F.min(F.when(F.col("verdict") == "gap", at)).over(whole)
        out = out.withColumn("verdict", F.when((at > gap) & F.col("verdict").isin("applied", "stale", "gap"), "faulted").otherwise(F.col("verdict")))
    if deletes:
        end = F.min(F.when((F.col("verdict") == "applied") & F.col(TYPE).isin(*deletes), at)).over(whole)
        out = out.withColumn("verdict", F.when(at > end, "state_not_found").otherwise(F.col("verdict")))
    out = out.withColumn("verdict", F.when(at > F.col("_ended").cast(log.schema[POSITION].dataType), "state_not_found").when(F.col("_ended").isNotNull(), "stale").otherwise(F.col("verdict")))
    return out.drop("_has", "_stored", "_bad", "_ended", "_in", "_last")


def failures(judged: DataFrame, model_name: str, instance_id: str) -> DataFrame:
    """First failure of each key: a gap is EventOutOfOrder, a missing state EventProcessing."""
    kind = F.when(F.col("verdict") == "gap", "EventOutOfOrder").when(F.col("verdict") == "state_not_found", "EventProcessing")
    bad = judged.withColumn("failure_type", kind).where("failure_type is not null")
    first = F.min_by(F.struct(NUMBER, POSITION, "created_on", "failure_type"), POSITION).alias("f")
    text = F.when(F.col("f.failure_type") == "EventOutOfOrder", F.concat(F.lit("out of order: "), F.col("f.event_number").cast("string"))).otherwise(F.concat(F.lit("no state for event "), F.col("f.event_number").cast("string")))
    return bad.groupBy(KEY).agg(first).select(
        F.lit(model_name).alias("model_name"), F.lit(instance_id).alias("instance_id"), KEY, "f.event_number", F.col("f.global_position").cast("string").alias("global_position"),
        F.col("f.created_on").alias("failure_created_on"), text.alias("exception"), F.col("f.failure_type").alias("failure_type"),
    )


def undecoded(batch: DataFrame, model_name: str, instance_id: str) -> DataFrame:
    """First event of each key whose payload could not be read, as a failure."""
    first = F.min_by(F.struct(NUMBER, POSITION, "created_on"), POSITION).alias("f")
    return batch.where("decode_status = 'failed'").groupBy(KEY).agg(first).select(
        F.lit(model_name).alias("model_name"), F.lit(instance_id).alias("instance_id"), KEY, "f.event_number", F.col("f.global_position").cast("string").alias("global_position"),
        F.col("f.created_on").alias("failure_created_on"), F.concat(F.lit("payload of event "), F.col("f.event_number").cast("string"), F.lit(" can't be read")).alias("exception"),
        F.lit("EventDeserialization").alias("failure_type"),
    )
