"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is P(class | history) * P(leaf | class, history) * P(token | leaf).
The first two factors are maximum-entropy models over hashed features of the history (the
leaves one, two and three back, the pair of the last two, and a bias), with `fan` outcomes
each; the last is an add-one unigram within the leaf, with one share for all unknown
tokens. The probabilities of a known token, or of "unknown" in a leaf, sum to one.

Weights are learnt by distributed gradient updates: in each round every task takes
mini-batch AdaGrad steps on its documents from the broadcast weights, and the tasks'
changes are averaged by tokens, slice by slice. Each training document is used in one of
the rounds. Token counts are exact and grow with the corpus: the `frequent` most frequent
tokens are looked up in a broadcast table of that size, all others by a join. The n-gram part has
`rows` x `fan` weights whatever the corpus.

Texts are hashed twice: for the counts, and once more into leaves (two bytes a token), which are
written and serve training and scoring.

Defined cases: a null text is empty and consists of the end token alone. Rows with equal
ids are separate documents. With no training rows, all counts are 0. An empty table gives no
rows. Columns other than those named are ignored. Tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

tk.ship(__name__)


@dataclass(frozen=True)
class ModelSettings:
    fan: int = 32  # classes, and leaves of a class
    own_leaf: int = 256  # so many of the most frequent tokens have a leaf each
    rows: int = 1 << 13  # hashed features of each of the two softmaxes
    frequent: int = 1 << 16
    rounds: int = 2
    rate: float = 0.25
    damp: float = 5.0
    batch: int = 8192
    slices: int = 256


END = np.uint64(0x5DEECE66D1CE4E5B)
_SLOTS = 20


def sequence(p: tk.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a piece with an end after each text; the text of each; affix hash of each; texts' bounds."""
    h = p.word_hashes(True)
    low = np.where((p.data >= 65) & (p.data <= 90), p.data + 32, p.data).astype(np.uint64)
    s, e = p.starts, p.ends
    second, before = np.where(s + 1 < e, s + 1, s), np.where(e - 2 >= s, e - 2, s)
    if len(s):
        front = (low[s] << np.uint64(8)) | low[second]
        back = (low[before] << np.uint64(8)) | low[e - 1]
    else:
        front = back = np.zeros(0, np.uint64)
    affix = (tk.mix64(back + np.uint64(77)) << np.uint64(32)) | (tk.mix64(front + np.uint64(7777)) & np.uint64(0xFFFFFFFF))
    at = np.arange(len(h)) + p.owner
    out, aff = np.full(len(h) + p.n, END), np.zeros(len(h) + p.n, np.uint64)
    out[at], aff[at] = h, affix
    owner = np.repeat(np.arange(p.n), np.diff(p.bounds) + 1)
    return out, owner, aff, p.bounds + np.arange(p.n + 1)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    for batch in batches:
        for p in tk.pieces(batch.column(0)):
            h, _, aff, _ = sequence(p)
            order = np.argsort(h, kind="stable")
            h, aff = h[order], aff[order]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            held.append((h[head], aff[head], np.diff(np.r_[head, len(h)])))
            size += len(head)
            if size > 2_000_000:
                yield _merged(held)
                held, size = [], 0
    if held:
        yield _merged(held)


def _merged(held) -> pa.RecordBatch:
    h, aff, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    h, aff, n = h[order], aff[order], n[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(aff[head].view(np.int64)), pa.array(np.add.reduceat(n, head).astype(np.int64))], names=["token", "affix", "n"])


@dataclass(frozen=True)
class Words:
    """What tasks need of the vocabulary; sent to them as a plain tuple."""

    fan: int
    own_leaf: int
    hashes: np.ndarray  # frequent tokens, most frequent first
    counts: np.ndarray
    table: np.ndarray  # slot -> place in hashes, or -1
    log_leaf: np.ndarray  # log10 of each leaf's denominator

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Place of each token among the frequent ones, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = self.table[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        return np.where((at >= 0) & (self.hashes[at] == h), at, -1)

    def leaves(self, place: np.ndarray, affix: np.ndarray) -> np.ndarray:
        return leaf_of(self, place, affix)


@dataclass(frozen=True)
class Model:
    settings: ModelSettings
    n: int
    v: int
    hashes: np.ndarray
    counts: np.ndarray
    table: np.ndarray
    log_leaf: np.ndarray
    w1: np.ndarray
    w2: np.ndarray

    def words(self) -> tuple:
        return self.settings.fan, self.settings.own_leaf, self.hashes, self.counts, self.table, self.log_leaf


def leaf_of(s: Words | ModelSettings, place: np.ndarray, affix: np.ndarray) -> np.ndarray:
    """A frequent token's own leaf, or else the leaf of its last and first letters."""
    first = s.own_leaf // s.fan
    hashed = (first + (affix >> np.uint64(32)) % np.uint64(s.fan - first)).astype(np.int64) * s.fan + (affix % np.uint64(s.fan)).astype(np.int64)
    return np.where((place >= 0) & (place < s.own_leaf), place, hashed)


@dataclass(frozen=True)
class Rows:
    """Feature rows of histories for the two softmaxes, as tables of the leaves they depend on; pairs are hashed."""

    one: np.ndarray  # (3, leaves + 1): rows of the leaves one, two and three back
    two: np.ndarray  # (2, fan, leaves + 1): rows of a class with the leaf one back, and two back
    alone: np.ndarray  # (fan,): rows of a class
    mask: int

    @staticmethod
    def of(s: ModelSettings) -> Rows:
        mask = np.uint64(s.rows - 1)
        leaves, fan = np.arange(s.fan * s.fan + 1, dtype=np.uint64), np.arange(s.fan, dtype=np.uint64)
        row = lambda kind, x: np.maximum(tk.mix64(x + np.uint64(kind << 40)) & mask, np.uint64(1)).astype(np.int64)
        pairs = fan[:, None] * np.uint64(1 << 16) + leaves
        return Rows(np.stack([row(k, leaves) for k in (1, 2, 3)]), np.stack([row(k, pairs) for k in (6, 7)]), row(5, fan), s.rows - 1)

    def features(self, leaf: np.ndarray, bounds: np.ndarray, fan: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows for the class (the bias is apart) and for the leaf in it; texts start after three marks."""
        texts = len(bounds) - 1
        padded = np.full(len(leaf) + 3 * texts, fan * fan, np.int64)
        at = np.arange(len(leaf)) + np.repeat(3 * np.arange(1, texts + 1), np.diff(bounds))
        padded[at] = leaf
        a, b, c = padded[at - 1], padded[at - 2], padded[at - 3]
        pair = ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 13) & self.mask
        k = leaf // fan
        return [self.one[0][a], self.one[1][b], self.one[2][c], np.maximum(pair, 1)], [self.alone[k], self.two[0][k, a], self.two[1][k, b]]


def log_softmax(w: np.ndarray, rows: list[np.ndarray], bias: bool) -> np.ndarray:
    """Of the sum of some rows; with `bias`, row 0 is added."""
    z = w[rows[0]]
    for r in rows[1:]:
        z += w[r]
    if bias:
        z += w[0]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def gradient(w: np.ndarray, rows: list[np.ndarray], target: np.ndarray, bias: bool) -> np.ndarray:
    """Mean gradient of the negative log likelihood of a mini-batch, for all rows."""
    g = np.exp(log_softmax(w, rows, bias))
    g[np.arange(len(target)), target] -= 1
    flat, columns = np.concatenate(rows), (g.T / np.float32(len(target))).astype(np.float64)
    out = np.empty((w.shape[1], w.shape[0]), np.float32)
    for k, column in enumerate(columns):
        out[k] = np.bincount(flat, np.concatenate([column] * len(rows)), len(w))
    if bias:
        out[:, 0] = columns.sum(1)
    return np.ascontiguousarray(out.T)


def step(w: np.ndarray, square: np.ndarray, rows: list[np.ndarray], target: np.ndarray, s: ModelSettings, bias: bool) -> None:
    """One AdaGrad step of a softmax on a mini-batch, in place; `damp` keeps rows with few tokens from large steps."""
    g = gradient(w, rows, target, bias)
    square += g * g
    w -= np.float32(s.rate) * g / (np.sqrt(square) + np.float32(s.damp / s.batch))


def _leaves(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of some texts (a binary column of 16-bit numbers) and the texts' bounds, about a million leaves at a time."""
    raw = [x.as_py() for x in column]
    sizes = np.array([len(x) // 2 for x in raw], np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(raw):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 200_000, "right")))
        yield np.frombuffer(b"".join(raw[i:j]), np.uint16).astype(np.int64), np.r_[0, np.cumsum(sizes[i:j])]
        i = j


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, first1, first2 = ModelSettings(*shared.value[0]), *shared.value[1:]
        table = Rows.of(s)
        w1, w2 = first1.copy(), first2.copy()
        q1, q2 = np.zeros_like(w1), np.zeros_like(w2)
        seen = 0
        for batch in batches:
            for leaf, bounds in _leaves(batch.column(0)):
                one, two = table.features(leaf, bounds, s.fan)
                mixed = np.random.default_rng(len(leaf)).permutation(len(leaf))
                for a in range(0, len(leaf), s.batch):
                    b = mixed[a : a + s.batch]
                    step(w1, q1, [r[b] for r in one], leaf[b] // s.fan, s, True)
                    step(w2, q2, [r[b] for r in two], leaf[b] % s.fan, s, False)
                seen += len(leaf)
        if seen:
            change = np.concatenate([(w1 - first1).ravel(), (w2 - first2).ravel()]) * np.float32(seen)
            cut = np.array_split(change, s.slices)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(s.slices), pa.int32()), pa.array([seen] * s.slices, pa.int64()), pa.array([c.astype(np.float32).tobytes() for c in cut], pa.binary())],
                names=["slice", "tokens", "change"],
            )

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the changes of each slice; holds one sum a slice, whatever the number of tasks."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(raw, np.float32).astype(np.float64)
            if k in sums:
                sums[k][0] += n
                sums[k][1] += x
            else:
                sums[k] = [n, x]
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())],
            names=["slice", "tokens", "change"],
        )


_CHANGE = "slice int, tokens long, change binary"


def vocabulary(training: DataFrame, scratch: tk.Scratch, settings: ModelSettings | None = None, text_col: str = "text") -> tuple[Model, DataFrame]:
    """Exact counts: a model whose softmaxes are still even, and the table (token, n) of all training tokens."""
    s = settings or ModelSettings()
    spark = training.sparkSession
    texts = training.select(F.col(f"`{text_col}`").alias("text"))
    counts = texts.mapInArrow(_counter, "token long, affix long, n long").groupBy("token").agg(F.min("affix").alias("affix"), F.sum("n").alias("n"))
    counts = scratch.save(counts)
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = tk.most_frequent(counts, "n", s.frequent).toArrow()  # `frequent` rows at most
    hashes, times = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((hashes, -times))
    hashes, times = hashes[order], times[order]
    table = np.full(1 << _SLOTS, -1, np.int32)
    slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
    table[slot[::-1]] = np.arange(len(hashes))[::-1]  # of two in a slot the more frequent stays; the other is joined like a rare one
    zero = np.zeros((s.rows, s.fan), np.float32)
    model = Model(s, size["n"], size["v"], hashes, times, table, np.zeros(s.fan * s.fan), zero, zero)
    shared = spark.sparkContext.broadcast(model.words())
    mass = counts.mapInArrow(_leaf_mass(shared), "leaf long, n long, v long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # one row a leaf
    denominator = np.ones(s.fan * s.fan)
    for r in mass:
        denominator[r["leaf"]] = r["n"] + r["v"] + 1
    return replace(model, log_leaf=np.log10(denominator)), counts.select("token", "n")


def train(coded: DataFrame, model: Model) -> Model:
    """The model after one pass over coded training documents (`leaves`, `turn`), in as many rounds as turns."""
    s, spark = model.settings, coded.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for turn in range(s.rounds):
        shared = spark.sparkContext.broadcast((astuple(s), model.w1, model.w2))  # rows x fan, both settings
        changes = coded.where(F.col("turn") == turn).select("leaves").mapInArrow(_trainer(shared), _CHANGE)
        sums = changes.repartition(parts, "slice").mapInArrow(_adder, _CHANGE).toArrow()  # one row a slice
        if sums.num_rows:
            order = np.argsort(sums["slice"].to_numpy())
            tokens = sums["tokens"].to_numpy()[order]
            raw = sums["change"].to_pylist()
            change = np.concatenate([np.frombuffer(raw[i], np.float64) / n for i, n in zip(order, tokens, strict=True)]).astype(np.float32)
            half = s.rows * s.fan
            model = replace(model, w1=model.w1 + change[:half].reshape(model.w1.shape), w2=model.w2 + change[half:].reshape(model.w2.shape))
    return model


def fit(training: DataFrame, scratch: tk.Scratch, settings: ModelSettings | None = None, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table (token, n) of all training tokens."""
    model, counts = vocabulary(training, scratch, settings, text_col)
    coded = code(training.select(F.col(f"`{text_col}`").alias("text")), model, scratch)
    return train(coded, model), counts


def _leaf_mass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Words(*shared.value)
        size = m.fan**2
        n, v = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            token, affix, times = (c.to_numpy() for c in batch.columns)
            leaf = m.leaves(m.look_up(token.view(np.uint64)), affix.view(np.uint64))
            np.add.at(n, leaf, times)
            np.add.at(v, leaf, 1)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at]), pa.array(v[at])], names=["leaf", "n", "v"])

    return run


_CODED = [("row", pa.int64()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()), ("logs", pa.float64()), ("leaf_logs", pa.float64()), ("leaves", pa.binary()), ("rare", pa.list_(pa.int64()))]


def _coder(shared, names: list[str]):
    """(columns, text) -> the columns, and what scoring and training need of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Words(*shared.value)
        log_count = np.log10(m.counts + 1.0)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            cols: list[list] = [[] for _ in _CODED]
            for p in tk.pieces(batch.column(batch.num_columns - 1)):
                h, owner, affix, bounds = sequence(p)
                place = m.look_up(h)
                leaf = m.leaves(place, affix)
                known = place >= 0
                logs = np.where(known, log_count[np.maximum(place, 0)], 0.0) if len(log_count) else np.zeros(len(h))
                cols[0] += range(row, row + p.n)
                row += p.n
                cols[1] += np.diff(bounds).tolist()
                cols[2] += np.bincount(owner, known, p.n).astype(np.int64).tolist()
                cols[3] += np.bincount(owner, logs, p.n).tolist()
                cols[4] += np.bincount(owner, m.log_leaf[leaf], p.n).tolist()
                narrow = leaf.astype(np.uint16)
                cols[5] += [narrow[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                rare = np.flatnonzero(~known)
                cut = np.searchsorted(rare, bounds)
                lists = h[rare].view(np.int64)
                cols[6] += [lists[cut[i] : cut[i + 1]] for i in range(p.n)]
            made = [pa.array(c, k) for c, (_, k) in zip(cols, _CODED, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return run


def code(docs: DataFrame, model: Model, scratch: tk.Scratch, text_col: str = "text") -> DataFrame:
    """The documents without their texts, with their leaves, counts and rare tokens, and the `turn` in which they are learnt from.

    Written once, so that texts are hashed once for training and scoring, and rows get their numbers once.
    Columns named like a result give way to it.
    """
    made = [name for name, _ in _CODED]
    own = [f for f in docs.schema if f.name not in (*made, "turn", text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model.words())  # `frequent` tokens at most
    rows = docs.select(*[F.col(f"`{f.name}`") for f in own], F.col(f"`{text_col}`").alias(tk.fresh(docs, "whole")[0]))
    schema = T.StructType([*own, *tk.fields("row long, n_tokens long, n_frequent long, logs double, leaf_logs double, leaves binary, rare array<bigint>")])
    coded = rows.mapInArrow(_coder(shared, schema.names), schema)
    return scratch.save(coded.withColumn("turn", F.pmod(F.xxhash64("leaves"), F.lit(model.settings.rounds))))


def _gainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w1, w2 = ModelSettings(*shared.value[0]), *shared.value[1:]
        table, ten = Rows.of(s), np.log(10)
        for batch in batches:
            out = [np.zeros(0)]
            for leaf, bounds in _leaves(batch.column(batch.num_columns - 1)):
                one, two = table.features(leaf, bounds, s.fan)
                gain = np.zeros(len(leaf))
                for a in range(0, len(leaf), s.batch):
                    b = slice(a, a + s.batch)
                    i = np.arange(len(leaf[b]))
                    gain[b] = log_softmax(w1, [r[b] for r in one], True)[i, leaf[b] // s.fan]
                    gain[b] += log_softmax(w2, [r[b] for r in two], False)[i, leaf[b] % s.fan]
                sums = np.r_[0.0, np.cumsum(gain)]
                out.append((sums[bounds[1:]] - sums[bounds[:-1]]) / ten)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out))], names=[*batch.schema.names[:-1], "gain"])

    return run


def score_coded(coded: DataFrame, model: Model, counts: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n_tokens, n_known, train_tokens, base_score, score) of coded documents; log10 probabilities of the text."""
    shared = coded.sparkSession.sparkContext.broadcast((astuple(model.settings), model.w1, model.w2))  # rows x fan, both settings
    own = coded.select(*[F.col(f"`{c}`") for c in columns], "row", "n_tokens", "n_frequent", "logs", "leaf_logs", "leaves")
    schema = T.StructType([*[f for f in own.schema if f.name != "leaves"], *tk.fields("gain double")])
    gained = own.mapInArrow(_gainer(shared), schema)
    rare = coded.select("row", F.explode("rare").alias("token")).join(counts, "token").groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_logs"))
    logs: Column = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return gained.join(rare, "row", "left").select(
        *[F.col(f"`{c}`") for c in columns], "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.v + 1)))).alias("base_score"), (logs - F.col("leaf_logs") + F.col("gain")).alias("score"),
    )


def score(docs: DataFrame, model: Model, counts: DataFrame, scratch: tk.Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    coded = code(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), model, scratch, text_col)
    return score_coded(coded, model, counts, [id_col])
