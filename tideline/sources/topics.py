"""Topic sources: settings, start offsets, record decoding, vector positions and lag."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import TopicOffsets
from ..functions.keys import guid


@dataclass(frozen=True)
class TopicSettings:
    servers: str
    topic: str
    group: str
    poll_ms: int = 250
    partitions: tuple[int, ...] = field(default=())

    def validate(self) -> TopicSettings:
        if not self.servers.strip() or not self.topic.strip() or not self.group.strip():
            raise ValueError("servers, topic and group must not be blank")
        if self.poll_ms <= 0:
            raise ValueError("the poll time must be positive")
        if len(set(self.partitions)) != len(self.partitions) or any(p < 0 for p in self.partitions):
            raise ValueError("partitions must be unique and not negative")
        return self


def resolve_partitions(found: list[int], wanted: tuple[int, ...] = ()) -> list[int]:
    """Partitions to read, in order: all that exist, or the wanted ones, which must exist."""
    if not found:
        raise ValueError("the topic has no partitions")
    if missing := set(wanted) - set(found):
        raise ValueError(f"no such partitions: {sorted(missing)}")
    return sorted(wanted or found)


def start_offsets(settings: TopicSettings, found: list[int], checkpoint: TopicOffsets | None) -> dict[int, int]:
    """Next offset of each partition: after the checkpoint, or -2 (earliest) where it has none."""
    if checkpoint and checkpoint.topic != settings.topic:
        raise ValueError(f"the checkpoint is of topic {checkpoint.topic}, not {settings.topic}")
    last = checkpoint.partitions if checkpoint else {}
    return {p: last[p] + 1 if p in last else -2 for p in resolve_partitions(found, settings.partitions)}


def reader_options(settings: TopicSettings, found: list[int], checkpoint: TopicOffsets | None = None) -> dict[str, str]:
    """Options of Spark's own topic reader for these settings."""
    s = settings.validate()
    start = start_offsets(s, found, checkpoint)
    return {
        "kafka.bootstrap.servers": s.servers, "assign": json.dumps({s.topic: sorted(start)}), "includeHeaders": "true",
        "startingOffsets": json.dumps({s.topic: {str(p): o for p, o in start.items()}}), "groupIdPrefix": s.group,
    }


def read_topic(spark: SparkSession, settings: TopicSettings, found: list[int], checkpoint: TopicOffsets | None = None, stream: bool = False) -> DataFrame:
    """A topic as (topic, partition, offset, key, value, headers, timestamp); needs Spark's connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    return reader.options(**reader_options(settings, found, checkpoint)).load()


def decode_records(records: DataFrame, parse=guid, mode: str = "strict") -> DataFrame:
    """Source records of a topic: key, event type and number are required, time and stream have fallbacks.

    `strict` stops at a bad record, `quarantine` keeps it with its reason in `record_error`.
    """
    key = parse(F.col("key").cast("string"))

    def last(name: str) -> Column:  # names match whatever their case; of several headers the last counts
        same = F.filter("headers", lambda h: F.lower(h["key"]) == name)
        return F.get(same, F.size(same) - 1)["value"].cast("string")

    type_ = last("event-type")
    n = last("event-number").try_cast("long")
    created = F.coalesce(F.try_to_timestamp(last("created-on")), F.col("timestamp"))
    error = F.when(key.isNull(), "key").when(F.coalesce(F.trim(type_), F.lit("")) == "", "event-type").when(n.isNull(), "event-number").when(created.isNull(), "created-on")
    out = records.select(
        "partition", "offset", key.alias("model_id"), type_.alias("event_type"), n.alias("event_number"), created.alias("created_on"),
        F.coalesce(last("stream-id"), F.concat_ws("-", F.col("topic"), key.cast("string"))).alias("stream_id"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("payload"), error.alias("record_error"),
    )
    if mode == "quarantine":
        return out
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    return out.withColumn("record_error", F.when(F.col("record_error").isNotNull(), F.raise_error(F.concat(F.lit("bad record: "), "record_error"))).cast("string"))


def vector_positions(records: DataFrame, partitions: list[int], order: str = "seq", block: int = 1 << 16) -> DataFrame:
    """Position of each record: the last offset of every partition up to it, in the order read.

    `records` are rows of a topic with `seq`, a number that gives their reading order; the partitions are
    known from the source, so each has its running maximum: within blocks of `block` numbers, each a group
    of its own, and on top of the blocks before, one row each.
    """
    rows = records.withColumn("_block", F.floor(F.col(order) / block))
    at = lambda p: F.max(F.when(F.col("partition") == p, F.col("offset")))
    within = Window.partitionBy("topic", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("topic").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("topic", "_block").agg(*[at(p).alias(f"_m{p}") for p in partitions])
    blocks = blocks.select("topic", "_block", *[F.max(f"_m{p}").over(before).alias(f"_b{p}") for p in partitions])
    rows = rows.select("*", *[at(p).over(within).alias(f"_w{p}") for p in partitions]).join(blocks, ["topic", "_block"])
    entries = [F.struct(F.lit(p).alias("key"), F.greatest(f"_w{p}", f"_b{p}").alias("value")) for p in sorted(partitions)]
    seen = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    text = F.concat(F.lit("{"), F.array_join(F.transform(seen, lambda e: F.concat(F.lit('"'), e["key"].cast("string"), F.lit('":'), e["value"].cast("string"))), ","), F.lit("}"))
    return rows.select(*[records[c] for c in records.columns], text.alias("offsets"))


def encode_records(log: DataFrame, topic: str, key: str = "model_id", payload: str = "payload") -> DataFrame:
    """The records that carry a log: topic, key, value and headers, as a topic's writer takes them; `decode_records` reads them again."""
    head = lambda name, v: F.struct(F.lit(name).alias("key"), v.cast("string").cast("binary").alias("value"))
    headers = F.array(head("event-type", F.col("event_type")), head("event-number", F.col("event_number")), head("created-on", F.date_format("created_on", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return log.select(F.lit(topic).alias("topic"), F.col(key).cast("string").cast("binary").alias("key"), F.col(payload).cast("binary").alias("value"), headers.alias("headers"))


def lag(heads: DataFrame) -> DataFrame:
    """(partition, position, high) -> lag of each partition and whether it is caught up; no position reads from the start."""
    behind = F.greatest(F.lit(0), F.col("high") - (F.coalesce("position", F.lit(-1)) + 1))
    return heads.select("partition", behind.cast("long").alias("lag"), (behind == 0).alias("caught_up"))
