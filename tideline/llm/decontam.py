"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into patterns (the whole of a short item, overlapping windows of a
longer one). A pattern of length m within k edits of a passage shares at least
m + 1 - q - k * q positioned q-grams with it, on diagonals no more than k apart. Shared
q-grams are counted in overlapping bands of diagonals; bands that meet the bound are
verified by banded alignment.

Text is compared as UTF-8 bytes, lower-cased (A-Z and Latin-1 letters), with every run of
other ASCII characters as one space. The benchmark is the query set: it is searched in
blocks of at most `block_bytes`, whose index is below `index_bytes`, each broadcast, against all
documents. A task expands at most about `SPREAD` postings at a time, however common a q-gram is.

An item of up to `whole` bytes matches with a tenth of it in edits, one of under `min_chars` only
exactly and between word ends, and one of under q bytes (no q-gram) only as the whole of a document.
A longer item matches by any window: a verbatim passage of it of `window + stride - 1` bytes or more
is always found, a shorter one only if it holds a window.

Defined cases: null and empty texts match nothing, nor do null items or items without a letter or
digit. Documents that are repeated are reported once a row; repeated items are each reported. Rows
with a null id are told apart by their texts. An empty table on either side gives no passages.
Columns other than ids and texts are ignored, whatever their names. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

tk.ship(__name__)


@dataclass(frozen=True)
class SearchRules:
    q: int = 8  # one machine word of bytes
    edit_rate: float = 0.1
    window: int = 96
    stride: int = 48
    whole: int = 128  # items up to so long are one pattern
    min_chars: int = 24  # below, no edits
    block_bytes: int = 1 << 20
    index_bytes: int = 48 << 20


SPREAD = 1 << 21
_CLEAN = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _CLEAN[_a:_b] = np.arange(_a, _b)
_CLEAN[65:91] = np.arange(97, 123)
_STEP = 16  # bands are two steps wide, one step apart; above the largest k


def normalise(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Comparable bytes of concatenated texts, and the place each came from; no run crosses a text's start."""
    x = _CLEAN[data]
    if len(x):
        latin = np.zeros(len(x), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        x[latin] |= 0x20
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[breaks[breaks < len(x)]] = True
    at = np.flatnonzero(keep)
    return x[at], at


def codes(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number."""
    if len(x) < 8:
        return np.zeros(0, np.uint64)
    c = x.astype(np.uint64)
    for shift in (1, 2, 4):
        c = (c[:-shift] << np.uint64(8 * shift)) | c[shift:]
    return c


@dataclass(frozen=True)
class Index:
    """Patterns of a block of items and the postings of their q-grams, as plain arrays."""

    of: np.ndarray  # item of each pattern
    begin: np.ndarray  # offset of each pattern in its item
    lengths: np.ndarray
    rows: np.ndarray  # the patterns, each from the start of its row
    edits: np.ndarray
    need: np.ndarray
    parts: np.ndarray  # patterns of each item
    exact: np.ndarray  # patterns that must end at word ends
    grams: np.ndarray
    first: np.ndarray
    pattern: np.ndarray
    place: np.ndarray
    sieve: np.ndarray  # bits of the q-grams' slots
    tiny: dict  # normalised item without a q-gram -> items

    def size(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))


def bare(text: str | None) -> np.ndarray:
    """Comparable bytes of a text without spaces at its ends."""
    x, _ = normalise(np.frombuffer((text or "").encode(), np.uint8), np.zeros(1, np.int64))
    held = np.flatnonzero(x != 32)
    return x[held[0] : held[-1] + 1] if len(held) else x[:0]


def build(texts: list[str | None], rules: SearchRules) -> Index:
    of, begin, patterns, edits, exact, parts, tiny = [], [], [], [], [], [], {}
    for n, text in enumerate(texts):
        x = bare(text)
        if len(x) < rules.q:
            parts.append(1)
            if len(x):
                tiny.setdefault(x.tobytes(), []).append(n)
            continue
        last = len(x) - rules.window
        cuts = [(0, len(x))] if len(x) <= rules.whole else [(a, a + rules.window) for a in sorted({*range(0, last, rules.stride), last})]
        parts.append(len(cuts))
        for a, b in cuts:
            of.append(n)
            begin.append(a)
            patterns.append(x[a:b])
            exact.append(b - a < rules.min_chars)
            edits.append(0 if exact[-1] else min(int(rules.edit_rate * (b - a)), (b - a - rules.q) // rules.q, _STEP - 1))
    narrow = lambda v: np.array(v, np.int32)
    lengths, k = narrow([len(p) for p in patterns]), narrow(edits)
    rows = np.zeros((len(patterns), int(lengths.max(initial=0))), np.uint8)
    for i, p in enumerate(patterns):
        rows[i, : len(p)] = p
    all_codes = [codes(p) for p in patterns] or [np.zeros(0, np.uint64)]
    flat = np.concatenate(all_codes)
    owner = np.repeat(np.arange(len(patterns), dtype=np.int32), [len(c) for c in all_codes][: len(patterns)])
    place = np.concatenate([np.arange(len(c), dtype=np.int32) for c in all_codes])
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    sieve = np.zeros(1 << 22, bool)
    sieve[_slot(grams)] = True
    need = lengths + 1 - rules.q - k * rules.q
    first = np.append(first, len(flat)).astype(np.int32)
    return Index(narrow(of), narrow(begin), lengths, rows, k, need, narrow(parts), np.array(exact, bool), grams, first, owner[order], place[order], np.packbits(sieve), tiny)


def _slot(c: np.ndarray) -> np.ndarray:
    return ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def align(text: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray, patterns: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of a whole pattern against any passage within a band of diagonals, and the passage's end.

    One candidate a row: its text is text[low:high], its pattern the first `lengths` bytes of
    its row, its band the `width` diagonals from `diagonal` (text place minus pattern place).
    """
    n, most = patterns.shape
    lanes = np.arange(width, dtype=np.int32)
    d = diagonal[:, None] + lanes
    big = np.int32(most + 1)
    low, high = low[:, None], high[:, None]
    cost = np.where((d >= low) & (d <= high), 0, big).astype(np.int32)
    best, end = np.full(n, big), np.zeros(n, np.int64)
    # Every candidate's text within reach of its band, with bytes of no pattern outside the text.
    at = diagonal[:, None] + np.arange(width + most)
    near = np.where((at >= low) & (at < high), text[np.minimum(np.maximum(at, 0), len(text) - 1)], 0)
    fits = np.where((at >= low) & (at <= high), 0, big).astype(np.int32)
    for j in range(1, most + 1):
        new = cost + (near[:, j - 1 : j - 1 + width] != patterns[:, j - 1 : j])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        new += fits[:, j : j + width]
        new -= lanes
        np.minimum.accumulate(new, axis=1, out=new)
        new += lanes
        cost = np.minimum(new, big, out=new)
        done = np.flatnonzero(lengths == j)
        if len(done):
            lane = cost[done].argmin(1)
            best[done], end[done] = cost[done, lane], diagonal[done] + lane + j
    return best, end


def search(index: Index, data: np.ndarray, offsets: np.ndarray, sieve: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, pattern, edits, first byte, end byte) of verified passages in concatenated texts; some more than once."""
    x, at = normalise(data, offsets)
    c = codes(x)
    bounds = np.searchsorted(at, offsets)
    if not len(c) or not len(index.grams):
        return
    hit = np.flatnonzero(sieve[_slot(c)])
    pos = np.searchsorted(index.grams, c[hit])
    ok = index.grams[np.minimum(pos, len(index.grams) - 1)] == c[hit]
    hit, pos = hit[ok], pos[ok]
    doc = np.searchsorted(bounds, hit, "right") - 1
    ok = hit + 8 <= bounds[doc + 1]  # no q-gram across texts
    hit, pos, doc = hit[ok], pos[ok], doc[ok]
    times = (index.first[pos + 1] - index.first[pos]).astype(np.int64)
    spread = np.cumsum(times)
    reach = int(index.lengths.max()) + 4 * _STEP  # places that one passage can span
    i = 0
    while i < len(hit):  # slices of so many postings, each with what a passage that ends in it can need
        j = max(i + 1, int(np.searchsorted(spread, (spread[i - 1] if i else 0) + SPREAD, "right")))
        part = slice(int(np.searchsorted(hit, hit[i] - reach)), j)
        yield from _slice(index, x, at, bounds, offsets, hit[part], pos[part], doc[part], times[part])
        i = j


def _slice(index: Index, x, at, bounds, offsets, hit, pos, doc, times) -> Iterator[tuple[int, int, int, int, int]]:
    low = int(hit[0])
    post = np.repeat(index.first[pos] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    pattern = index.pattern[post].astype(np.int64)
    shift = 4 * _STEP * 64 - low
    diagonal = np.repeat(hit, times) - index.place[post] + shift
    band = diagonal // _STEP
    first_doc = int(doc[0])
    n_patterns, n_bands = len(index.of), int(band.max()) + 2
    key = (np.repeat(doc - first_doc, times) * n_patterns + pattern) * n_bands + band
    keys, count = np.unique(key, return_counts=True)
    # A band is two steps: that of the key and the next.
    following = np.searchsorted(keys, keys + 1)
    found = np.minimum(following, len(keys) - 1)
    both = count + np.where(keys[found] == keys + 1, count[found], 0)
    strong = both >= index.need[(keys // n_bands) % n_patterns]
    mine = keys[strong]
    kinds = (mine // n_bands) % n_patterns
    docs, edits, lengths = mine // n_bands // n_patterns + first_doc, index.edits[kinds].astype(np.int64), index.lengths[kinds].astype(np.int64)
    start = (mine % n_bands) * _STEP - shift - edits
    width = 2 * _STEP + 2 * int(index.edits.max())
    for a in range(0, len(mine), 1024):
        s = slice(a, a + 1024)
        rows = index.rows[kinds[s], : int(lengths[s].max())]
        cost, end = align(x, bounds[docs[s]], bounds[docs[s] + 1], start[s], rows, lengths[s], width)
        for i in np.flatnonzero(cost <= edits[s]):
            d, k, m = int(docs[a + i]), int(kinds[a + i]), int(lengths[a + i])
            stop = min(max(int(end[i]), int(bounds[d]) + 1), int(bounds[d + 1]))
            begin = max(int(bounds[d]), stop - m)
            if index.exact[k] and not _at_word_ends(x, begin, stop, int(bounds[d]), int(bounds[d + 1])):
                continue
            yield d, k, int(cost[i]), int(at[begin] - offsets[d]), int(at[stop - 1] + 1 - offsets[d])


def _at_word_ends(x: np.ndarray, begin: int, stop: int, low: int, high: int) -> bool:
    return (begin == low or x[begin - 1] == 32) and (stop == high or x[stop] == 32)


def _finder(shared, names: list[str]):
    kinds = [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        sieve = np.unpackbits(index.sieve).view(bool)
        least = max(map(len, index.tiny), default=0)
        for batch in batches:
            rows, found = [], {}
            for data, offsets, first in tk.spans(batch.column(1)):
                for d, k, cost, a, b in search(index, data, offsets, sieve):
                    one = found.setdefault((first + d, int(index.of[k])), {})
                    if k not in one or one[k][0] > cost:
                        one[k] = (cost, a, b)
                if least:  # only texts with so few comparable bytes can be a tiny item
                    x, at = normalise(data, offsets)
                    bounds = np.searchsorted(at, offsets)
                    for d in np.flatnonzero(np.diff(bounds) <= least + 2):
                        whole = x[bounds[d] : bounds[d + 1]].tobytes().strip(b" ")
                        for n in index.tiny.get(whole, ()):
                            found[(first + int(d), n)] = {0: (0, 0, int(offsets[d + 1] - offsets[d]))}
            for (d, item), one in sorted(found.items()):
                rows.append((d, item, sum(v[0] for v in one.values()), int(index.parts[item]), len(one), min(v[1] for v in one.values()), max(v[2] for v in one.values())))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=names)

    return run


def _indexes(items: list[tuple], rules: SearchRules) -> Iterator[tuple[list[tuple], Index]]:
    """Indexes of a block of items, cut in halves until each is below its bound (a single item makes one whatever its size)."""
    index = build([t for _, t in items], rules)
    if index.size() <= rules.index_bytes or len(items) == 1:
        yield items, index
    else:
        for half in (items[: len(items) // 2], items[len(items) // 2 :]):
            yield from _indexes(half, rules)


def find_passages(docs: DataFrame, benchmark: DataFrame, rules: SearchRules | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, edits, n_windows, windows, begin, end) of every document and item with a matching pattern.

    `windows` of the item's `n_windows` patterns matched, with `edits` in all; begin and end are
    UTF-8 byte offsets of the passage in the document (the begin is exact up to the edits).
    """
    rules = rules or SearchRules()
    spark = docs.sparkSession
    item_kind = benchmark.schema[item_col].dataType
    query = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("item_text")).where("item_text is not null")
    total = query.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // rules.block_bytes))
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    schema = T.StructType([docs.schema[id_col], *tk.fields("item long, edits long, n_windows long, windows long, begin long, end long")])
    out = []
    for block in range(blocks):
        held = [tuple(r) for r in query.where(F.pmod(F.xxhash64("item_text"), F.lit(blocks)) == block).collect()]  # about `block_bytes`
        held.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        for items, index in _indexes(held, rules):
            shared = spark.sparkContext.broadcast(tuple(vars(index).values()))  # `index_bytes` at most
            found = rows.mapInArrow(tk.released(_finder(shared, schema.names)), schema)
            names = T.StructType([T.StructField("n", T.LongType()), T.StructField("item_id", item_kind)])
            of = F.broadcast(tk.local(spark, [(i, r[0]) for i, r in enumerate(items)], names))  # no larger than the index
            out.append(found.join(of, found["item"] == of["n"]).select(found[id_col], of["item_id"], "edits", "n_windows", "windows", "begin", "end"))
    return reduce(DataFrame.unionByName, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rules: SearchRules | None = None, id_col: str = "doc_id") -> DataFrame:
    """The documents in which no item was found, told apart by id and text: other rows of the same or a null id stay."""
    named = docs.select(F.struct(F.col(id_col).alias("id"), tk.text_key(F.col("text")).alias("key")).alias("bad"), "text")
    bad = find_passages(named, benchmark, rules, "bad").select(F.col("bad.id").alias("bad_id"), F.col("bad.key").alias("bad_key")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]) & (tk.text_key(docs["text"]) == bad["bad_key"]), "left_anti")
