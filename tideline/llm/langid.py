"""Language identification as mixture inference.

Each language has a smoothed distribution over hashed byte trigrams. For a document, EM
estimates the proportions of the languages from its trigram counts; the language set is
the one of the best penalised log likelihood among the nested sets of largest proportions.

The search of larger sets ends when a bound on the likelihood of any mixture cannot pay for a
further language: that of the full mixture plus its duality gap, which EM makes small.

Defined cases: a null text, or one without a letter, is `und` with score 0 and an empty
set. A label that is null teaches nothing. With no labelled row at all, every document is
`und`. Ties between languages go to the smaller label. Repeated rows get equal results; an empty
table gives no rows. Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

tk.ship(__name__)


@dataclass(frozen=True)
class MixtureSettings:
    """`per_language` bounds (in expectation) the labelled rows that a language is learnt from.

    `penalty` is in units of log(n) per further language; trigrams overlap, so it is above
    the 0.5 that independent draws would take.
    """

    buckets: int = 1 << 15
    per_language: int = 20_000
    smoothing: float = 0.05
    rounds: int = 40
    penalty: float = 6.0
    max_languages: int = 1000
    cells: int = 1 << 22  # of the table of buckets and languages, at most: with many languages buckets are fewer


_LETTER_BYTES = np.full(256, 32, np.uint8)
_LETTER_BYTES[128:] = np.arange(128, 256)
_LETTER_BYTES[97:123] = np.arange(97, 123)
_LETTER_BYTES[65:91] = np.arange(97, 123)


def grams(p: tk.Piece, buckets: int) -> Iterator[np.ndarray]:
    """Bucket of each byte trigram of each text, A-Z folded, other ASCII as a space; blanks are left out."""
    x = _LETTER_BYTES[p.data].astype(np.uint32)
    if len(x) < 3:
        for _ in range(p.n):
            yield np.zeros(0, np.uint16)
        return
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.uint32)
    bucket = (bucket & np.uint32(buckets - 1)).astype(np.uint16)
    use = ~((x[:-2] == 32) & (x[1:-1] == 32))
    for i in range(p.n):
        a, b = p.offsets[i], max(p.offsets[i], p.offsets[i + 1] - 2)
        yield bucket[a:b][use[a:b]]


def tally(g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts."""
    if len(g) < 256:
        return np.unique(g, return_counts=True)
    n = np.bincount(g, minlength=buckets)
    at = np.flatnonzero(n)
    return at, n[at]


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for p in tk.pieces(batch.column(0)):
                for i, g in enumerate(grams(p, buckets)):
                    t = tables.setdefault(langs[p.first + i], np.zeros(buckets, np.int64))
                    at, n = tally(g, buckets)
                    t[at] += n
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at], pa.int64())], names=["lang", "bucket", "n"])

    return run


@dataclass(frozen=True)
class MixtureModel:
    languages: list[str]
    prob: np.ndarray  # buckets x languages
    log_prob: np.ndarray
    settings: MixtureSettings


def fit(labelled: DataFrame, settings: MixtureSettings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> MixtureModel:
    """Learn from rows with a label and a text, at most about `per_language` of each label, chosen by hash."""
    s = settings or MixtureSettings()
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(s.max_languages + 1).collect()}
    if len(sizes) > s.max_languages:
        raise ValueError(f"more than {s.max_languages} labels; raise max_languages")
    languages = sorted(sizes)
    if languages:
        s = replace(s, buckets=min(s.buckets, 1 << (s.cells // len(languages)).bit_length() - 1))
    if not languages:
        return MixtureModel([], np.zeros((s.buckets, 0)), np.zeros((s.buckets, 0)), s)
    if any(n > s.per_language for n in sizes.values()):
        share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, s.per_language / n)))])[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    counts = rows.select("text", "lang").mapInArrow(tk.released(_counter(s.buckets)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    place = {k: i for i, k in enumerate(languages)}
    table = np.zeros((s.buckets, len(languages)))
    got = counts.toArrow()
    np.add.at(table, (got["bucket"].to_numpy(), np.array([place[x] for x in got["lang"].to_pylist()], int)), got["n"].to_numpy())
    prob = smoothed(table, s.smoothing)
    return MixtureModel(languages, prob, np.log(prob), s)


def smoothed(table: np.ndarray, alpha: float) -> np.ndarray:
    """Columns as distributions, with additive smoothing."""
    return ((table + alpha) / (table.sum(0) + alpha * len(table))).astype(np.float64)


def em(like: np.ndarray, counts: np.ndarray, rounds: int, close: float = 0.5) -> tuple[np.ndarray, float, float]:
    """Mixture proportions of the columns of `like` for the counted grams, their log likelihood, and how far any may be above it.

    The log likelihood is concave, so the largest slope towards one column bounds what is left to gain;
    rounds end when that is `close`.
    """
    k, total = like.shape[1], counts.sum()
    pi = np.full(k, 1.0 / k)
    mixed = like @ pi
    slope = (counts / mixed) @ like
    for _ in range(rounds if k > 1 else 0):
        if slope.max() - total <= close:
            break
        pi = np.maximum(slope * pi / total, 1e-12)
        pi /= pi.sum()
        mixed = like @ pi
        slope = (counts / mixed) @ like
    return pi, float(counts @ np.log(mixed)), max(0.0, float(slope.max() - total))


def infer(model: MixtureModel, g: np.ndarray) -> list[tuple[int, float]]:
    """(language index, proportion) of the chosen set, largest first."""
    s = model.settings
    at, counts = tally(g, s.buckets)
    like, counts = model.prob[at], counts.astype(np.float64)
    price = s.penalty * np.log(max(2.0, counts.sum()))
    singles = counts @ model.log_prob[at]
    first = int(np.argmax(np.round(singles, 9)))
    best, chosen = float(singles[first]), [(first, 1.0)]
    pi, full, gap = em(like, counts, s.rounds)
    order = np.lexsort((np.arange(len(pi)), -np.round(pi, 9)))
    for k in range(2, len(pi) + 1):
        if full + gap - price * (k - 1) <= best:
            break  # no mixture of so many languages or more can make up for its price
        top = order[:k]
        part, ll, _ = em(like[:, top], counts, s.rounds)
        if ll - price * (k - 1) > best:
            best, chosen = ll - price * (k - 1), [(int(top[j]), float(part[j])) for j in np.lexsort((top, -np.round(part, 9)))]
    return chosen


RESULTS = ("lang_pred", "score", "lang_set", "lang_shares")


def _predictor(shared, names: list[str]):
    """(columns, text) -> the columns, and the prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prob, settings = shared.value
        model = MixtureModel(languages, prob, np.log(prob), MixtureSettings(*settings))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            pred, score, sets, shares = [], [], [], []
            for p in tk.pieces(texts):
                for i, g in enumerate(grams(p, model.settings.buckets)):
                    text = texts[p.first + i].as_py()
                    chosen = []
                    if text and model.languages and any(map(str.isalpha, text)):
                        if not len(g):  # letters, but too short for a trigram: the texts around it say nothing
                            g = np.zeros(1, np.uint16)
                        chosen = infer(model, g)
                    pred.append(model.languages[chosen[0][0]] if chosen else "und")
                    score.append(min(1.0, chosen[0][1]) if chosen else 0.0)
                    sets.append([model.languages[j] for j, _ in chosen])
                    shares.append([v for _, v in chosen])
            made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return run


def predict(docs: DataFrame, model: MixtureModel, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """Predicted language, its share, and the chosen set with all shares, of every document.

    They stand in columns named by `results`, beside the id, or beside the documents' `columns`, which must have other names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prob, astuple(model.settings)))  # `cells` numbers at most
    own = [docs.schema[c] for c in ([id_col] if columns is None else columns)]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in own], F.col(f"`{text_col}`").alias(tk.fresh(docs, "whole")[0]))
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType()))
    schema = T.StructType([*own, *[T.StructField(n, k) for n, k in zip(results, kinds, strict=True)]])
    return rows.mapInArrow(tk.released(_predictor(shared, schema.names)), schema)


def keep_known(docs: DataFrame, model: MixtureModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns as they were, of which one language has at least the share `least`."""
    names = tk.fresh(docs, *RESULTS)
    found = predict(docs, model, text_col=text_col, columns=docs.columns, results=tuple(names))
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
