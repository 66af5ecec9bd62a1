"""Runners of a projection: `foreachBatch` into versioned tables, or keyed state; catch-up, then live.

A batch reads the stored rows of its keys, judges and folds its events over them, and puts
the changes by compare and set; then its checkpoint follows. That gives at least once, and the batch
number in each table makes a repeat a no-op. Only changed rows are written.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import decode, fold, order, sink
from ..operators import reducers as R
from ..operators.order import KEY, NUMBER, POSITION, TYPE
from ..operators.sink import flush_metrics
from ..operators.spec import ProjectionSpec
from ..operators.store import GONE, ProjectionStore


def carried(batch: DataFrame, stored: DataFrame, spec: ProjectionSpec) -> DataFrame:
    """Fields of the batch's models: set by the batch, or else as stored; sums and arrays go on from the stored ones."""
    new = fold.declarative(batch, spec)
    touched = [n for n in spec.fields if R.kind_of(list(fold.reducers_of(spec, n).values())) == "set"]
    marks = [F.coalesce(F.max(F.col(TYPE).isin(*fold.reducers_of(spec, n))), F.lit(False)).alias(f"_set_{n}") for n in touched]
    firsts = batch.groupBy(KEY).agg(*marks, F.min_by(TYPE, POSITION).alias("_first"))
    s = stored.select(F.col(KEY).alias("_key"), F.col(NUMBER).alias("_stored"), *[F.col(n).alias(f"_old_{n}") for n in spec.fields])
    rows = new.join(firsts, KEY).join(s, new[KEY] == s["_key"], "left")
    out = []
    for n, kind in spec.fields.items():
        how = R.kind_of(list(fold.reducers_of(spec, n).values()))
        if how == "set":
            out.append(F.when(F.col(f"_set_{n}"), F.col(n)).otherwise(F.col(f"_old_{n}")).alias(n))
        elif how == "sum":
            out.append((F.col(n) + F.coalesce(f"_old_{n}", F.lit(0).cast(kind))).cast(kind).alias(n))
        else:
            out.append(F.concat(F.coalesce(f"_old_{n}", F.array().cast(kind)), F.col(n)).alias(n))
    return rows.select(KEY, NUMBER, POSITION, *out, F.col("_key").isNull().alias("is_new"), F.col("deleted").alias("should_delete"), F.coalesce("_stored", F.lit(-1)).cast("long").alias("expected_event_number"))


class EventRefused(RuntimeError):
    """An event that the projection's policies do not let pass."""


def checked(batch: DataFrame, spec: ProjectionSpec) -> DataFrame:
    """The batch with `decode_status` (ok, unknown, failed), ruled by the projection's policies.

    `on_unknown` and `on_decode_error` = "error" stop the query at such an event; "ignore" leaves it
    out; with "quarantine" a failed event stays as such, is not applied, and becomes a failure.
    """
    known = F.when(F.col(TYPE).isin(*spec.known), "ok").otherwise("unknown")
    status = F.when(F.col("decode_status") == "failed", "failed").otherwise(known) if "decode_status" in batch.columns else known
    return decode.policy(batch.withColumn("decode_status", status), spec.on_unknown, spec.on_decode_error)


@dataclass
class BatchRunner:
    """State, failures and checkpoints of one projection, batch by batch.

    A batch writes failures, then models, then its checkpoint, each by the batch's number: one that is
    cut off is run again over the same stored models, finds the same failures, and writes what is
    missing. A deleted key has ended: it is kept as a mark, so that the result does not depend on where
    batches are cut. With `on_gap="halt"`, the failure rows are written and the batch is refused.
    `on_flush` gets the counts of each flush.
    """

    spec: ProjectionSpec
    store: ProjectionStore
    policy: str = "relational"
    limits: dict[str, int] | None = None
    on_flush: Callable[[dict], None] | None = None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spec, instance, store = self.spec, self.spec.settings.instance_id, self.store
        began = time.monotonic()
        batch = checked(batch, spec).persist()
        mine = store.state.read().join(batch.select(KEY).distinct(), KEY, "left_semi").persist()
        readable = batch.where("decode_status <> 'failed'").drop("decode_status")
        judged = order.verdicts(readable, spec.settings.version_check, spec.initial, spec.deletes, mine).persist()
        applied = judged.where("verdict = 'applied'")
        live = mine.where(~F.coalesce("is_deleted", F.lit(False)))
        changes = sink.normalise(sink.collapse(carried(applied, live, spec)))
        outcome = sink.classify(live, changes, self.policy, self.limits).persist()
        failed = order.failures(judged, spec.model_name, instance).unionByName(order.undecoded(batch, spec.model_name, instance))
        written = sink.persistence_failures(outcome, spec.model_name, instance, F.lit(None).cast("timestamp_ntz"), self.limits)
        fresh = sink.new_failures(store.failures.read(), failed.unionByName(written), self.policy)
        if fresh.limit(1).count():
            store.failures.put(fresh.withColumn(GONE, F.lit(False)), batch_id)
        if spec.on_gap == "halt" and (gap := judged.where("verdict = 'gap'").first()) is not None:
            for df in (batch, mine, judged, outcome):
                df.unpersist()
            raise EventRefused(f"event {gap[NUMBER]} of {gap[KEY]} is out of order")
        merged = sink.merge(live, outcome, list(spec.fields)).withColumn("is_deleted", F.lit(False))
        stopped = failed.where("failure_type = 'EventOutOfOrder'").select(F.col(KEY).alias("_bad")).distinct()
        merged = merged.join(stopped, merged[KEY] == stopped["_bad"], "left").withColumn("has_faulted", F.col("has_faulted") | F.col("_bad").isNotNull()).drop("_bad")
        ends = F.col(TYPE).isin(*spec.deletes) if spec.deletes else F.lit(False)
        ended = applied.where(ends).groupBy(KEY).agg(F.max(NUMBER).alias(NUMBER), F.max(POSITION).alias(POSITION))
        ended = ended.select("*", *[F.lit(None).cast(kind).alias(n) for n, kind in spec.fields.items()], F.lit(False).alias("has_faulted"), F.lit(True).alias("is_deleted"))
        rows = merged.join(ended.select(KEY), KEY, "left_anti").unionByName(ended)
        store.state.put(rows.withColumn(GONE, F.lit(False)), batch_id)
        seen = batch.agg(F.max(POSITION).cast("string").alias("global_position")).where("global_position is not null")
        point = seen.select(F.lit(spec.model_name).alias("model_name"), F.lit(instance).alias("instance_id"), "global_position")
        store.checkpoints.write(sink.put_checkpoints(store.checkpoints.read(), point), batch_id)
        if self.on_flush is not None:
            counts = flush_metrics(outcome).first().asDict()
            self.on_flush(counts | {"batch_id": batch_id, "loaded": mine.count(), "seconds": time.monotonic() - began})
        for df in (batch, mine, judged, outcome):
            df.unpersist()
        store.vacuum()

    def start(self, stream: DataFrame, checkpoint: str, catch_up: bool, interval: str | None = None) -> StreamingQuery:
        """Run over all that is there (`catch_up`), or go on as events come, flushed as the settings of that phase say."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        live = interval or self.spec.settings.live.trigger()
        return (writer.trigger(availableNow=True) if catch_up else writer.trigger(processingTime=live)).start()

    def catch_up_then_live(self, stream, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Drain what is there, then go live on the same checkpoint; `stream` makes the source anew."""
        self.start(stream(), checkpoint, True).awaitTermination()
        return self.start(stream(), checkpoint, False, interval)


def caught_up(query: StreamingQuery) -> bool:
    """Whether the last trigger found nothing to read."""
    last = query.lastProgress
    return last is not None and last["numInputRows"] == 0


class FoldProcessor(StatefulProcessor):
    """Keyed state of a projection: one row of plain values a model, folded event by event.

    It judges as `order.verdicts` does: a gap stops the key (`has_faulted`, and a failure), a delete
    ends it, an event before the initial one has no state. `python_handlers` take the place of reducers.
    """

    def __init__(self, spec: ProjectionSpec):
        self.names, self.initial, self.ends, self.check = list(spec.fields), spec.initial, set(spec.deletes), spec.settings.version_check
        self.reducers, self.handlers = {k: dict(v) for k, v in spec.handlers.items()}, dict(spec.python_handlers)
        self.known, self.on_unknown = set(spec.known), spec.on_unknown
        self.sums = {n for n in self.names if any(isinstance(r, R.SUMS) for r in fold.reducers_of(spec, n).values())}
        self.shape = f"{NUMBER} long, {POSITION} long, " + ", ".join(f"{n} {k}" for n, k in spec.fields.items()) + ", has_faulted boolean, is_deleted boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", self.shape)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        columns = [NUMBER, POSITION, *self.names, "has_faulted", "is_deleted"]
        old = dict(zip(columns, self.state.get(), strict=True)) if self.state.exists() else None
        failure = None
        for e in pd.concat(list(rows)).sort_values([POSITION, NUMBER]).to_dict("records"):
            if e[TYPE] not in self.known:
                if self.on_unknown == "error":
                    raise RuntimeError(f"unknown event {e[TYPE]}")
                continue
            n = int(e[NUMBER])
            if old is None and self.initial in (None, e[TYPE]):
                old = {NUMBER: -1, POSITION: -1, **{n: 0 if n in self.sums else None for n in self.names}, "has_faulted": False, "is_deleted": False}
            if old is None or old["is_deleted"]:
                failure = failure or f"no state for event {n}"
                continue
            stale = self.check != "disabled" and n <= old[NUMBER]
            if old["has_faulted"] or stale:
                continue
            if self.check == "consecutive" and n != old[NUMBER] + 1:
                old["has_faulted"], failure = True, failure or f"out of order: {n}"
                continue
            if e[TYPE] in self.handlers:
                old |= {k: v for k, v in self.handlers[e[TYPE]]({k: old[k] for k in self.names}, e).items() if k in self.names}
            else:
                for name, r in self.reducers.get(e[TYPE], {}).items():
                    v = r.value(e)
                    v = None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v
                    old[name] = v if isinstance(r, R.SETTERS) else old[name] + (v or 0)
            old[NUMBER], old[POSITION], old["is_deleted"] = n, int(e[POSITION]), e[TYPE] in self.ends
        if old is not None:
            self.state.update(tuple(old[c] for c in columns))
        if old is not None or failure is not None:
            yield pd.DataFrame([{KEY: key[0], **(old or dict.fromkeys(columns)), "failure": failure}])

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, spec: ProjectionSpec, key_type: str = "bigint") -> DataFrame:
    """States of the models of each micro-batch, from keyed state in RocksDB, and the first failure in it; set and summed fields."""
    fields = ", ".join(f"{n} {k}" for n, k in spec.fields.items())
    shape = f"{KEY} {key_type}, {NUMBER} long, {POSITION} long, {fields}, has_faulted boolean, is_deleted boolean, failure string"
    return stream.groupBy(KEY).transformWithStateInPandas(FoldProcessor(spec), outputStructType=shape, outputMode="Update", timeMode="None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
