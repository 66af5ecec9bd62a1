"""Fixed virtual slots and a versioned slot-to-shard map.

A record's key is hashed into one of `slots` virtual slots, for ever. A map assigns slots to
shards; it is stored in versions, and growing or rebalancing edits only the entries that
move. Bytes are aggregated per slot, so a rebalance reads one row a slot and never a record.

Two edits exist. `grown` adds a shard and gives it the slots that the key hash alone
decides, so that key and shard count determine a record's shard. `rebalanced` moves slots
by their bytes from shards above the mean to those below.

Defined cases: a null key hashes as the empty string; a null text has 0 bytes and its CRC
is 0. Repeated rows are kept, and stand side by side in their shard. Empty tables give no
rows. Columns other than those named are ignored. A key that holds many rows is counted
before any shuffle by key, and its places are spread out again afterwards, so that no task
gathers its rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk


def slot_of(key: Column, slots: int) -> Column:
    """Virtual slot of a key: the first 32 bits of the MD5 of its text, modulo `slots`."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots))


def _weight(slot: int, shard: int) -> int:
    return int.from_bytes(hashlib.md5(f"{slot}:{shard}".encode()).digest()[:8], "big")


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard of each slot, the version before it, and the slots that moved."""

    shards: int
    owner: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    @staticmethod
    def fresh(slots: int, shards: int) -> SlotMap:
        """The map of `shards` shards: grown from one shard, one at a time, so that it depends on nothing else."""
        m = SlotMap(1, (0,) * slots)
        while m.shards < shards:
            m = m.grown()
        return SlotMap(m.shards, m.owner)

    def grown(self) -> SlotMap:
        """One shard more. Each old shard gives up what is above its fair share: the slots that weigh most for the new one."""
        new, owner = self.shards, list(self.owner)
        held: dict[int, list[int]] = {k: [] for k in range(new)}
        for slot, shard in enumerate(owner):
            held[shard].append(slot)
        keep, more = divmod(len(owner) - len(owner) // (new + 1), new)
        moved = []
        for place, shard in enumerate(sorted(held, key=lambda k: (-len(held[k]), k))):
            spare = max(0, len(held[shard]) - keep - (place < more))
            moved += sorted(held[shard], key=lambda s: (-_weight(s, new), s))[:spare]
        for slot in moved:
            owner[slot] = new
        return SlotMap(new + 1, tuple(owner), self.version + 1, tuple(sorted(moved)))

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """Edit the map until no shard is above the mean by more than `tolerance`, or no move of a slot helps."""
        load, owner = [0] * self.shards, list(self.owner)
        for slot, shard in enumerate(owner):
            load[shard] += slot_bytes.get(slot, 0)
        mean, moved = sum(load) / self.shards, set()
        while load and max(load) > mean * (1 + tolerance):
            top, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = (load[top] - load[low]) / 2
            fits = [(slot_bytes.get(s, 0), s) for s, o in enumerate(owner) if o == top and 0 < slot_bytes.get(s, 0) <= gap]
            if not fits:
                break
            size, slot = max(fits)
            owner[slot] = low
            load[top] -= size
            load[low] += size
            moved.add(slot)
        return SlotMap(self.shards, tuple(owner), self.version + 1, tuple(sorted(moved)))


class MapStore:
    """Versions of a map as tables of one folder: a row a slot, never changed once written.

    An edit reads the newest version, and writes only where nobody else has written the next one yet.
    """

    SCHEMA = "shards int, virtual_slot long, shard int, moved boolean, bytes long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(int(n[1:]) for n in (x.getPath().getName() for x in self._fs.listStatus(self._path(""))) if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{n}/_SUCCESS")))

    def load(self, version: int | None = None) -> SlotMap | None:
        """A version of the map, or the newest; none where nothing is stored. `slots` rows are read."""
        known = self.versions()
        if not known:
            return None
        version = known[-1] if version is None else version
        rows = sorted(self.read(version).select("virtual_slot", "shard", "shards", "moved").collect())
        return SlotMap(rows[0]["shards"], tuple(r["shard"] for r in rows), version, tuple(r["virtual_slot"] for r in rows if r["moved"]))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/v{version}")

    def save(self, m: SlotMap, slot_bytes: dict[int, int]) -> SlotMap:
        """Write a version with the bytes of each slot, `slots` rows; fails if that version is there."""
        rows = [(m.shards, s, o, s in set(m.moved), slot_bytes.get(s, 0)) for s, o in enumerate(m.owner)]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("error").parquet(f"{self.root}/v{m.version}")
        return m


def sized(docs: DataFrame, slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every record."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), slot_of(F.col(id_col), slots).alias("virtual_slot"))


@dataclass(frozen=True)
class Sharding:
    """Placed records, and the stored map: the version that placed them, one shard more, and edited by bytes."""

    placed: DataFrame
    maps: MapStore
    base: int
    grown: int
    even: int


_SUB = 16  # a slot's places are counted in so many parts, so that a key with many different texts is split
_RUN = 1 << 16  # equal rows get their places in runs of so many


def shard(docs: DataFrame, shards: int = 16, slots: int = 4096, id_col: str = "doc_id", text_col: str = "text", root: str | None = None) -> Sharding:
    """Place every record: its shard now, with one shard more, and after a rebalance by bytes; and its place in its shard.

    `placed` has id, size, text_crc32, virtual_slot, shard, slot (from 0 without gaps in each
    shard), grown_shard and rebalanced_shard. The map is the newest under `root` (a first one is
    written if there is none); its edits become the versions after it.
    """
    spark = docs.sparkSession
    scratch = tk.Scratch(spark, "shards")
    store = MapStore(spark, root or scratch.path("map"))
    # One row for all rows that are equal in what is placed: their places follow from a count.
    kinds = scratch.save(sized(docs, slots, id_col, text_col).groupBy(id_col, "size", "text_crc32", "virtual_slot").agg(F.count("*").alias("n")))
    kinds = kinds.withColumn("sub", F.pmod("text_crc32", F.lit(_SUB)))
    per_sub = kinds.groupBy("virtual_slot", "sub").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")).collect()  # slots x _SUB rows at most
    totals: dict[int, int] = {}
    for r in per_sub:
        totals[r["virtual_slot"]] = totals.get(r["virtual_slot"], 0) + r["bytes"]
    base = store.load() or store.save(SlotMap.fresh(slots, shards), totals)
    if len(base.owner) != slots or base.shards != shards:
        raise ValueError(f"the stored map has {len(base.owner)} slots and {base.shards} shards")
    grown = store.save(base.grown(), totals)
    even = store.save(replace(base.rebalanced(totals), version=grown.version + 1), totals)
    start, filled = [], [0] * shards
    for r in sorted(per_sub, key=lambda r: (r["virtual_slot"], r["sub"])):
        s, o = r["virtual_slot"], base.owner[r["virtual_slot"]]
        start.append((s, r["sub"], filled[o]))
        filled[o] += r["rows"]
    starts = F.broadcast(spark.createDataFrame(start, "virtual_slot long, sub long, start long"))
    owner = [store.read(m.version).select("virtual_slot", F.col("shard").alias(name)) for m, name in ((base, "shard"), (grown, "grown_shard"), (even, "rebalanced_shard"))]
    w = f"OVER (PARTITION BY virtual_slot, sub ORDER BY `{id_col}`, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    places = kinds.withColumn("before", F.expr(f"sum(n) {w} - n")).join(starts, ["virtual_slot", "sub"])
    for version in owner:  # `slots` rows each
        places = places.join(F.broadcast(version), "virtual_slot")
    places = places.select(
        id_col, "size", "text_crc32", "virtual_slot", "shard", "grown_shard", "rebalanced_shard", (F.col("start") + F.col("before")).alias("from"), F.expr("start + before + n - 1").alias("to")
    )
    runs = places.withColumn("run", F.explode(F.sequence("from", "to", F.lit(_RUN)))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), id_col, "run")
    placed = runs.withColumn("slot", F.explode(F.sequence("run", F.least(F.col("to"), F.col("run") + _RUN - 1))))
    return Sharding(placed.drop("from", "to", "run"), store, base.version, grown.version, even.version)


def write_shards(docs: DataFrame, sharding: Sharding, path: str, id_col: str = "doc_id", columns: list[str] | None = None) -> None:
    """Write the records as one folder a shard; records of one key are alike placed, so a semi-distinct join suffices."""
    where = sharding.placed.select(F.col(id_col).alias("placed_id"), "shard").distinct()
    docs = docs.select(columns) if columns else docs
    docs.join(where, docs[id_col].eqNullSafe(where["placed_id"])).drop("placed_id").write.partitionBy("shard").parquet(path)
