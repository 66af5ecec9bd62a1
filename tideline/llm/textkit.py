"""Vectorised byte-level text kernels and small Spark helpers shared by the operators.

Kernels work on the UTF-8 buffer of an Arrow string column in pieces of about
`PIECE` bytes (one text at least), so their memory is bounded by the longest text.
Words are maximal runs of bytes outside {0x20, 0x09..0x0D}; UTF-8 never puts those
bytes inside a longer character, so byte words equal character words.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ship(name: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULT = mix64(np.arange(1001, 1041, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
def kept(key, make, of=None):
    """A value made once a process and kept while `of` is the same: functions are pickled by value, so a task's globals are new each time."""
    store = vars(sys).setdefault("_tideline_kept", {})
    if key not in store or store[key][0] != of:
        store.pop(key, None)
        store[key] = (of, make())
    return store[key][1]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64; kept, rounded up to a power of two."""
    size = max(PIECE, 1 << max(0, n - 1).bit_length())

    def make():
        out = np.ones(1, np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        return out

    return kept(("powers", base, size), make)[:n] if size == PIECE else make()[:n]


class Piece:
    """Some consecutive texts of a batch: bytes, text offsets, and their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        space = _SPACES[data]
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        word = ~space
        before = np.ones(len(data), bool)
        before[1:] = space[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = space[1:]
        self.is_word = word
        self.starts = np.flatnonzero(word & (before | head[:-1]))
        self.ends = np.flatnonzero(word & (after | head[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of text i: bounds[i]..bounds[i+1]
        self.owner = np.repeat(np.arange(self.n), np.diff(self.bounds))

    def word_hashes(self, fold: bool) -> np.ndarray:
        """64-bit hash of each word; fold lower-cases A-Z first."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _TABLE)[self.data] * powers(_BASE, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * powers(_INVERSE, n)[self.starts] if n else np.zeros(0, np.uint64)
        return mix64(h + (self.ends - self.starts).astype(np.uint64) * _GOLDEN)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of `width` words inside one text, and its first word."""
        last = len(hashes) - width + 1
        if last <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        s = np.zeros(last, np.uint64)
        for j in range(width):
            s += hashes[j : j + last] * _MULT[j]
        at = np.flatnonzero(self.owner[:last] == self.owner[width - 1 :])
        return mix64(s[at]), at

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in the mask."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def shingle_sets(piece: Piece, width: int = 5) -> Iterator[np.ndarray]:
    """Per text: sorted distinct shingle hashes (uint64) of the A-Z-folded words.

    Fewer than `width` words make one shingle of the whole sequence; none make an empty set.
    """
    h = piece.word_hashes(True)
    w, at = piece.windows(h, width)
    cut = np.searchsorted(at, piece.bounds)
    for i in range(piece.n):
        a, b = piece.bounds[i], piece.bounds[i + 1]
        if b - a >= width:
            yield np.unique(w[cut[i] : cut[i + 1]])
        elif b > a:
            n = b - a
            yield mix64((h[a:b] * _MULT[8 : 8 + n]).sum(keepdims=True) + np.array([n], np.uint64) * _GOLDEN)
        else:
            yield np.zeros(0, np.uint64)


def release() -> None:
    """Give memory that a task is done with back: idle workers wait for other tasks beside their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries keep what is freed, and have this
    if trim is not None:
        trim(0)


def released(run):
    """A task's function that gives memory back when its own variables are gone, and not before."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def spans(column: pa.Array, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, text offsets, first row) of consecutive texts of about `size` bytes, one text at least; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i
        i = j


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """Cut an Arrow string column into pieces; a null counts as an empty text."""
    for data, offsets, first in spans(column, size):
        yield Piece(data, offsets, first)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of its own only where none is set on a local master, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir: executors need a folder that all of them share")
        import tempfile

        where = spark.conf.get("spark.tideline.scratch", None)
        if not where:
            where = f"file://{tempfile.mkdtemp(prefix='tideline-')}"
            spark.conf.set("spark.tideline.scratch", where)
    return where.rstrip("/")


BATCH_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    """Spark cuts Arrow batches by rows, 10,000 unless set: too many for whole texts. Only the default is changed."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written in the shared folder to cut lineage; dropped one by one when no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tideline_path = path
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._tideline_path)


_NARROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def chunked(docs: DataFrame, scratch: Scratch, rows: int) -> tuple[DataFrame, Column]:
    """The documents as they stand in files, and a column that names runs of `rows` rows of a file.

    The names are the same whenever the files are read. Documents that do not come straight from files are written first.
    """
    todo, narrow = [docs._jdf.queryExecution().analyzed()], True
    while todo and narrow:
        plan = todo.pop()
        narrow = plan.nodeName() in _NARROW
        below = plan.children()
        todo += [below.apply(i) for i in range(below.size())]
    if narrow:
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
        except AnalysisException:
            narrow = False
    docs = docs if narrow else scratch.save(docs)
    at = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(at["file_path"], F.floor(at["row_index"] / rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PLAIN = (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType)


def local(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows of the driver as a table. Plain types go by Arrow: else executors start Python workers of another kind, only to unpickle them."""
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows or not all(isinstance(f.dataType, _PLAIN) for f in shape):
        return spark.createDataFrame(rows, shape)
    columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True), shape, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=shape.names), shape)


def fields(ddl: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(ddl))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text):
    """SHA-256 of a text, null as empty: with an id it names rows that are equal in both."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def most_frequent(df: DataFrame, n_col: str, most: int) -> DataFrame:
    """Rows of the largest counts, `most` at most: all those from a count on that a histogram gives.

    The histogram has under 10,000 rows whatever the input, so no task or driver sorts the rows.
    """
    n = F.col(n_col)
    band = F.when(n < 4096, n.cast("long")).otherwise(F.lit(4096 - 12 * 64) + F.floor(F.log2(n) * 64))
    bands = sorted(((r["band"], r["rows"]) for r in df.groupBy(band.alias("band")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for b, rows in bands:
        if total + rows > most:
            break
        least, total = b, total + rows
    return df.where(F.lit(False)) if least is None else df.where(band >= least)
