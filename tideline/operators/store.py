"""Versioned Parquet tables with a pointer: a batch writes a new version, and one new file makes it current.

A version is a list of segments, oldest first: a base and the changes of later batches. A batch
writes its changed rows only; segments of like size are merged, so a row is rewritten about as often
as the logarithm of the table over a batch. A version records the batch that made it, so a batch that
is run again changes nothing. All access is through Hadoop's file system; a pointer is created only
where none of its number exists, which stores of files and of objects both can tell.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GONE = "_gone"


class VersionedTable:
    """A table of the schema; with `keys`, rows can be put and removed by key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[str]:
        pointers = self._p("pointers")
        if not self._fs.exists(pointers):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(pointers) if s.getPath().getName().endswith(".json"))

    def _pointer(self, name: str) -> dict | None:
        """A version's record; none for one whose writer died in it."""
        stream = self._fs.open(self._p(f"pointers/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def pointer(self) -> dict:
        """Segments, batch and number of the current version; number 0 where there is none."""
        for name in reversed(self._versions()):
            if (now := self._pointer(name)) is not None:
                return now
        return {"version": 0, "batch_id": None, "segments": []}

    def _rows(self, segments: list[dict]) -> DataFrame:
        """The newest row of each key of some segments, with removed ones as such."""
        shape = self.schema + (f", {GONE} boolean" if self.keys else "")
        parts = [self.spark.read.schema(shape).parquet(f"{self.path}/{s['folder']}") for s in segments]
        if not parts:
            return self.spark.createDataFrame([], shape)
        if len(parts) == 1:
            return parts[0]
        every = parts[0].withColumn("_at", F.lit(0))
        for i, p in enumerate(parts[1:], 1):
            every = every.unionByName(p.withColumn("_at", F.lit(i)))
        columns = [c for c in parts[0].columns if c not in self.keys]
        newest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "_at").alias("_row"))
        return newest.select(*self.keys, "_row.*").select(*parts[0].columns)

    def read(self) -> DataFrame:
        rows = self._rows(self.pointer()["segments"])
        return rows.where(~F.coalesce(GONE, F.lit(False))).drop(GONE) if self.keys else rows

    def _segment(self, df: DataFrame) -> dict:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "rows": self.spark.read.parquet(f"{self.path}/{folder}").count()}

    def _commit(self, now: dict, batch_id: int | None, segments: list[dict]) -> None:
        names = self._versions()
        version = int(names[-1].split(".")[0]) + 1 if names else 1
        self._fs.mkdirs(self._p("pointers"))
        try:
            out = self._fs.create(self._p(f"pointers/{version:012d}.json"), False)  # fails if it is there
        except Py4JJavaError as e:
            raise RuntimeError(f"version {version} of {self.path} was written by someone else") from e
        out.write(bytearray(json.dumps({"version": version, "batch_id": now["batch_id"] if batch_id is None else batch_id, "segments": segments}).encode()))
        out.close()

    def _done(self, now: dict, batch_id: int | None) -> bool:
        return batch_id is not None and now["batch_id"] is not None and batch_id <= now["batch_id"]

    def write(self, df: DataFrame, batch_id: int | None = None) -> bool:
        """Make `df` the whole current version, unless the current one is of this batch or a later one already."""
        now = self.pointer()
        if self._done(now, batch_id):
            return False
        self._commit(now, batch_id, [self._segment(df.withColumn(GONE, F.lit(False)) if self.keys else df)])
        return True

    def put(self, changes: DataFrame, batch_id: int | None = None) -> bool:
        """Put the rows by key; those whose `_gone` is true are removed. The same as to repeats as `write`."""
        now = self.pointer()
        if self._done(now, batch_id):
            return False
        segments = [*now["segments"], self._segment(changes.select(*[c.split(" ")[0] for c in self._columns()], GONE))]
        while len(segments) > 1 and 2 * segments[-1]["rows"] >= segments[-2]["rows"]:
            merged = self._rows(segments[-2:])
            if len(segments) == 2:
                merged = merged.where(~F.coalesce(GONE, F.lit(False)))  # below the base there is nothing to hide
            segments[-2:] = [self._segment(merged)]
        self._commit(now, batch_id, segments)
        return True

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def vacuum(self, keep: int = 2) -> int:
        """Drop all versions but the last few, and the segments that none of these has; returns how many versions went."""
        names = self._versions()
        old, held = names[:-keep], set()
        for name in names[-keep:]:
            held |= {s["folder"] for s in (self._pointer(name) or {"segments": []})["segments"]}
        for name in old:
            for s in (self._pointer(name) or {"segments": []})["segments"]:
                if s["folder"] not in held:
                    self._fs.delete(self._p(s["folder"]), True)
            self._fs.delete(self._p(f"pointers/{name}"), True)
        return len(old)


class ProjectionStore:
    """State, failures and checkpoints of one deployment, each a versioned table under its own folder."""

    FAILURES = "model_name string, instance_id string, model_id {key}, event_number bigint, global_position string, failure_created_on timestamp_ntz, exception string, failure_type string"
    CHECKPOINTS = "model_name string, instance_id string, global_position string"

    def __init__(self, spark: SparkSession, root: str, model: str, instance_id: str, key_type: str, fields: dict[str, str], position_type: str = "bigint"):
        self.spark = spark
        base = f"{root.rstrip('/')}/{model}/{instance_id}"
        body = ", ".join(f"{n} {t}" for n, t in fields.items())
        state = f"model_id {key_type}, event_number bigint, global_position {position_type}, {body}, has_faulted boolean, is_deleted boolean"
        self.state = VersionedTable(spark, f"{base}/state", state, ("model_id",))
        self.failures = VersionedTable(spark, f"{base}/failures", self.FAILURES.format(key=key_type), ("model_name", "instance_id", "model_id"))
        self.checkpoints = VersionedTable(spark, f"{base}/checkpoints", self.CHECKPOINTS)

    def models(self) -> DataFrame:
        """The live models; a deleted one stays in `state` as a mark that its key has ended."""
        return self.state.read().where(~F.coalesce("is_deleted", F.lit(False))).drop("is_deleted")

    def create(self) -> None:
        """First versions of the tables that have none."""
        for t in (self.state, self.failures, self.checkpoints):
            if not t.pointer()["version"]:
                t.write(self.spark.createDataFrame([], t.schema))

    def reset(self) -> None:
        """Empty tables: the next run reads its source from the start."""
        for t in (self.state, self.failures, self.checkpoints):
            t.write(self.spark.createDataFrame([], t.schema), None)

    def vacuum(self, keep: int = 2) -> int:
        return sum(t.vacuum(keep) for t in (self.state, self.failures, self.checkpoints))
