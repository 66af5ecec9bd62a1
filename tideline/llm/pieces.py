"""SentencePiece encoding and decoding as a relational lattice.

A text is cut into units between any two neighbouring characters that stand side by side in no
piece, so that no piece can cross a cut and the best path of a text is that of its units. For each
distinct unit, its substrings up to the longest piece with the same beginning are exploded and
equi-joined with the piece table; the edges are grouped by unit and a Viterbi fold (`aggregate`)
keeps the path of the largest total score, then of the fewest edges, then with the longer last
piece. A character that is no piece is an edge of its UTF-8 bytes, scored below every piece.

The ids of the `frequent` most frequent units are a table of that size, which a task reads from the
shared folder and drops at its end. All other units are joined with the documents' chunks (runs of
`CHUNK` rows of a file): a task reads those of its chunk, whatever the number of units in the corpus.

Defined cases: null and empty texts have no pieces. A space is put before every text and taken away
again by `decode`; U+2581 in a text is written as bytes, so that decoding gives back every text
exactly. A unit is as long as its pairs allow, without a cap; its lattice lies in one task. Rows are
coded one by one, so repeated rows and null ids need no rule. An empty table gives no rows. All columns
stay, whatever their names; one that is named like the result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

tk.ship(__name__)

CHUNK = 4096
_PIECE = 1 << 18
_ROWS = 256  # results go out in batches of so many rows, so that ids of few texts are held at once
_FLUSH = 400_000  # distinct units that a counting task holds
_BUCKET = 400_000  # units of the corpus for each folder of chunks
_STEM = 4  # characters by which the length of candidates is bounded
_BLOCK = 512  # links of a long unit are kept in blocks, so that a fold copies no long array


@dataclass(frozen=True)
class PieceTable:
    """Pieces as they stand in text (a space for U+2581), their ids and scores, and the id of byte 0."""

    pieces: list[tuple[str, int, float]]
    byte_zero: int
    names: list[str | int]  # by id: the text of a piece, or the value of a byte

    @staticmethod
    def load(path: str) -> PieceTable:
        """From a SentencePiece model file, read on the driver."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, names, zero = [], [], None
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                zero = i if zero is None else zero
                names.append(i - zero)
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                names.append("")
            else:
                names.append(text.replace("▁", " "))
                pieces.append((names[-1], i, float(sp.get_score(i))))
        if zero is None:
            raise ValueError("the model has no byte pieces")
        return PieceTable(pieces, zero, names)

    def pairs(self) -> set[str]:
        """Neighbouring characters of all pieces."""
        return {p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1)}


JOINED, CUT, ASK = range(3)


def joins(table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """For two neighbouring bytes: whether a unit goes on, ends, or their characters must be asked; and the pairs of such characters."""
    byte = np.full((256, 256), ASK, np.uint8)
    byte[:, 0x80:0xC0] = JOINED  # inside a character
    byte[:0x80, :0x80] = CUT
    wide = []
    for a, b in sorted(table.pairs()):
        if ord(a) < 0x80 and ord(b) < 0x80:
            byte[ord(a), ord(b)] = JOINED
        else:
            wide.append(ord(a) << 21 | ord(b))
    return byte.reshape(-1), np.array(sorted(wide), np.uint64)


def _points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at some places."""
    first = data[at].astype(np.uint32)
    tail = [(data[np.minimum(at + j, len(data) - 1)] & 0x3F).astype(np.uint32) for j in (1, 2, 3)]
    two = (first & 0x1F) << 6 | tail[0]
    three = (first & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    return np.where(first < 0x80, first, np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)))


class Units:
    """Units of some texts, each of which has its space before it: bytes, bounds, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rules: tuple[np.ndarray, np.ndarray]):
        byte, wide = rules
        self.data, n = data, len(data)
        cut = np.zeros(n + 1, bool)
        if n:
            say = byte[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
            cut[1:-1] = say == CUT
            ask = np.flatnonzero(say == ASK) + 1
            if len(ask):
                lead = ask - 1
                for _ in range(3):
                    inside = (data[lead] & 0xC0) == 0x80
                    if not inside.any():
                        break
                    lead = lead - inside
                pair = _points(data, lead).astype(np.uint64) << np.uint64(21) | _points(data, ask)
                place = np.searchsorted(wide, pair)
                cut[ask] = np.append(wide, np.uint64(0))[place] != pair
        cut[offsets] = True  # an empty text begins where the next one does
        self.starts = np.flatnonzero(cut[:-1])
        self.ends = np.append(self.starts[1:], n) if len(self.starts) else self.starts
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        if not n:
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tk._TABLE[self.data] * tk.powers(tk._BASE, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * tk.powers(tk._INVERSE, n)[self.starts]
        return tk.mix64(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def texts(self, which: np.ndarray) -> pa.Array:
        """Some units as strings."""
        a, n = self.starts[which], (self.ends - self.starts)[which]
        ends = np.cumsum(n)
        flat = self.data[np.repeat(a - np.r_[0, ends[:-1]], n) + np.arange(int(n.sum()))] if len(which) else np.zeros(0, np.uint8)
        offsets = pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes())
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, offsets, pa.py_buffer(flat.tobytes())])


def _led(text):
    """A text with a space before it, if it has any."""
    return F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit(""))


def _merged(held: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    h, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    return h[order][head], np.add.reduceat(n[order], head), pa.concat_arrays([x[2] for x in held]).take(pa.array(order[head]))


def _counter(rules_of):
    """Led texts -> (hash, unit, n) of their distinct units, as far as a task can hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = rules_of.value
        held, size, last = [], 0, 0

        def out(one):
            return pa.RecordBatch.from_arrays([pa.array(one[0].view(np.int64)), one[2].cast(pa.string()), pa.array(one[1])], names=["hash", "unit", "n"])

        for batch in batches:
            for data, offsets, _ in tk.spans(batch.column(0), _PIECE):
                u = Units(data, offsets, rules)
                h, first, n = np.unique(u.hashes(), return_index=True, return_counts=True)
                held.append((h, n, u.texts(first)))
                size += len(h)
                if size > max(_FLUSH // 2, 2 * last):
                    held = [_merged(held)]
                    size = last = len(held[0][0])
                    if size > _FLUSH // 2:
                        yield out(held[0])
                        held, size, last = [], 0, 0
        if held:
            yield out(_merged(held))

    return run


_SHORT = 128  # edges


def short_fold() -> str:
    """SQL of the Viterbi fold over `edges`, sorted by end and start, for a unit of few edges.

    The state is the best way to each position: its score, its edges (negative), and the start
    (negative) and id of its last edge, so that the greater of two ways is the better. Every position
    has an edge into it, the one of its last character. At the end the starts are followed back.
    """
    way = "named_struct('score', a[x.s].score + x.score, 'less', a[x.s].less - 1, 'back', -x.s, 'id', x.id)"
    once = "transform(array(a[x.s]), p -> named_struct('score', p.score + x.score, 'less', p.less - 1, 'back', -x.s, 'id', x.id))"
    better = f"if(a[x.e].score > a[x.s].score + x.score, a, concat(slice(a, 1, x.e), array(greatest(a[x.e], {way}))))"
    step = "named_struct('at', -a[b.at].back, 'ids', concat(array(a[b.at].id), b.ids))"
    start = "named_struct('at', size(a) - 1, 'ids', cast(array() as array<int>))"
    walk = f"aggregate(sequence(1, -element_at(a, -1).less), {start}, (b, i) -> {step}, b -> b.ids)"
    none = "array(named_struct('score', 0D, 'less', 0, 'back', 0, 'id', 0))"
    return f"aggregate(edges, {none}, (a, x) -> if(x.e = size(a), concat(a, {once}), {better}), a -> {walk})"


def long_fold(longest: int) -> str:
    """The same in time linear in the edges, whatever the length of the unit.

    `now` is the best way to position `at`; `win` has those to the `longest` positions before it, and
    `links` (in blocks) the start and id of the last edge of every finished position.
    """
    links, score = "array<struct<start:int,id:int>>", "struct<score:double,size:int>"
    now = "named_struct('start', a.now.start, 'id', a.now.id)"
    best = "named_struct('score', a.now.score, 'size', a.now.size)"
    way = lambda was: f"named_struct('score', {was}.score + x.score, 'size', {was}.size + 1, 'start', x.s, 'id', x.id)"
    back = "a.win[size(a.win) - (a.at - x.s)]"
    was = f"if(x.s = a.at, {best}, {back})"
    win = f"if(size(a.win) < {longest}, concat(a.win, array({best})), concat(slice(a.win, 2, {longest - 1}), array({best})))"
    full = f"size(a.cur) >= {_BLOCK}"
    opened = (
        f"named_struct('at', x.e, 'now', {way(was)}, 'win', {win}, "
        f"'cur', if({full}, array({now}), concat(a.cur, array({now}))), 'done', if({full}, concat(a.done, array(a.cur)), a.done))"
    )
    better = f"{back}.score + x.score > a.now.score or ({back}.score + x.score = a.now.score and {back}.size + 1 < a.now.size)"
    replaced = f"named_struct('at', a.at, 'now', {way(back)}, 'win', a.win, 'cur', a.cur, 'done', a.done)"
    start = (
        "named_struct('at', 0, 'now', named_struct('score', 0D, 'size', 0, 'start', -1, 'id', 0), "
        f"'win', cast(array() as array<{score}>), 'cur', cast(array() as {links}), 'done', cast(array() as array<{links}>))"
    )
    many = f"size(b.cur) >= {_BLOCK}"
    step = (
        f"named_struct('at', b.links[b.at].start, 'links', b.links, 'cur', if({many}, array(b.links[b.at].id), concat(b.cur, array(b.links[b.at].id))), "
        f"'done', if({many}, concat(b.done, array(b.cur)), b.done))"
    )
    walk = (
        f"aggregate(sequence(1, a.now.size), named_struct('at', a.at, 'links', flatten(concat(a.done, array(concat(a.cur, array({now}))))), "
        f"'cur', cast(array() as array<int>), 'done', cast(array() as array<array<int>>)), (b, i) -> {step}, "
        "b -> reverse(flatten(concat(b.done, array(b.cur)))))"
    )
    return f"aggregate(edges, {start}, (a, x) -> if(x.e > a.at, {opened}, if({better}, {replaced}, a)), a -> {walk})"


def lattice(units: DataFrame, table: PieceTable) -> DataFrame:
    """(hash, n, ids) of distinct units (hash, unit, n), dealt out by hash, so that each is whole in one task.

    An unknown character is an edge too; until the end its id stands as -1 - code point.
    """
    spark = units.sparkSession
    longest = max(len(p) for p, _, _ in table.pieces)
    lowest = min(s for _, _, s in table.pieces) - 10.0
    stems: dict[str, int] = {}
    for p, _, _ in table.pieces:
        if len(p) >= _STEM:
            stems[p[:_STEM]] = max(stems.get(p[:_STEM], 0), len(p))
    pieces = F.broadcast(tk.local(spark, table.pieces, "piece string, id int, score double"))  # the piece table: fixed
    bounds = F.broadcast(tk.local(spark, list(stems.items()), "stem string, most int"))  # no larger than it
    starts = units.select("hash", "unit", "n", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    starts = starts.withColumn("stem", F.expr(f"substring(unit, s + 1, {_STEM})")).join(bounds, "stem", "left")
    reach = f"least(s + coalesce(most, {_STEM - 1}), length(unit))"
    spans = starts.select("hash", "unit", "n", "s", F.explode(F.expr(f"sequence(s + 1, {reach})")).alias("e"))
    spans = spans.select("hash", "n", "s", "e", F.expr("substring(unit, s + 1, e - s)").alias("piece"))
    edges = spans.join(pieces, "piece", "left").where("id is not null or e = s + 1")
    edge = F.struct("e", "s", F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(lowest)).alias("score"))
    grouped = edges.select("hash", "n", edge.alias("edge")).groupBy("hash", "n").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    best = F.when(F.size("edges") <= _SHORT, F.expr(short_fold())).otherwise(F.expr(long_fold(longest)))
    return grouped.select("hash", "n", best.alias("ids"))


def as_bytes(ids: np.ndarray, offsets: np.ndarray, byte_zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids with each -1 - code point as the ids of its UTF-8 bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, offsets
    raw = [np.frombuffer(chr(-1 - int(ids[i])).encode(), np.uint8).astype(np.int32) + byte_zero for i in odd]
    times = np.ones(len(ids), np.int64)
    times[odd] = [len(r) for r in raw]
    out = np.repeat(ids, times)
    first = np.r_[0, np.cumsum(times)]
    for i, r in zip(odd, raw, strict=True):
        out[first[i] : first[i] + len(r)] = r
    return out, first[offsets]


@dataclass(frozen=True)
class Lookup:
    """Ids of units by hash: hashes in order, the first place of each range of their top bits, and the ids."""

    hashes: np.ndarray
    starts: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    shift: np.uint64

    @staticmethod
    def build(parts: list[tuple[np.ndarray, pa.Array]], byte_zero: int) -> Lookup:
        """From (signed hashes, lists of ids), which are taken out of `parts` one by one."""
        hashes, lengths, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        while parts:
            h, lists = parts.pop(0)
            flat, cuts = as_bytes(lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())], byte_zero)
            hashes.append(h.view(np.uint64))
            lengths.append(np.diff(cuts))
            ids.append(flat.astype(np.uint16 if not len(flat) or flat.max() < 1 << 16 else np.int32))
        h, n, flat = np.concatenate(hashes), np.concatenate(lengths), np.concatenate(ids)
        del hashes, lengths, ids
        bounds = np.r_[0, np.cumsum(n)]
        order = np.argsort(h, kind="stable")
        h, begins, ends = h[order], bounds[:-1][order], bounds[1:][order]  # the ids stay where they are
        bits = max(1, len(h).bit_length() - 1)
        shift = np.uint64(64 - bits)
        counts = np.bincount((h >> shift).astype(np.int64), minlength=1 << bits)
        return Lookup(h, np.r_[0, np.cumsum(counts)].astype(np.int32), begins.astype(np.int32), ends.astype(np.int32), flat, shift)

    @staticmethod
    def load(uri: str, byte_zero: int, chunk: int | None = None) -> Lookup:
        """All rows of a folder of Parquet files, or those of a chunk; a folder that is not there has none."""
        fs, base = pafs.FileSystem.from_uri(uri)
        if fs.get_file_info(base).type == pafs.FileType.NotFound:
            return Lookup.build([], byte_zero)
        parts = []
        if chunk is None:
            files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
            batches = (b for f in files for b in pq.ParquetFile(f, filesystem=fs).iter_batches(1 << 16, columns=["hash", "ids"], use_threads=False))
        else:
            rows = pads.dataset(base, filesystem=fs, format="parquet", exclude_invalid_files=False)
            batches = rows.to_batches(columns=["hash", "ids"], filter=pads.field("chunk") == chunk, use_threads=False, batch_readahead=1, fragment_readahead=1)
        for b in batches:
            parts.append((b["hash"].to_numpy(), b["ids"]))
        return Lookup.build(parts, byte_zero)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            found = self.hashes[at[left]] == h[left]
            out[left[found]] = at[left[found]]
            left = left[~found]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def _runs(chunk: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(first row, rows, value) of each run of equal chunks."""
    c = chunk.to_numpy()
    head = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
    for a, b in zip(head, np.append(head[1:], len(c)), strict=True):
        yield int(a), int(b - a), int(c[a])


def _rare(rules_of, uri: str, byte_zero: int):
    """(led text, chunk) -> (chunk, hash) of units that are not in the table, each once as far as a run goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, look = rules_of.value, Lookup.load(uri, byte_zero)
        tk.release()  # what the table was built from
        held, size, of = [], 0, None

        def out():
            h = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), of)), pa.array(h.view(np.int64))], names=["chunk", "hash"])

        for batch in batches:
            for a, n, chunk in _runs(batch.column(1)):
                if held and (chunk != of or size > _FLUSH):
                    yield out()
                    held, size = [], 0
                of = chunk
                for data, offsets, _ in tk.spans(batch.column(0).slice(a, n), _PIECE):
                    h = np.unique(Units(data, offsets, rules).hashes())
                    held.append(h[look.places(h) < 0])
                    size += len(held[-1])
        if held:
            yield out()

    return run


def _encoder(rules_of, uri: str, fills: str, buckets: int, byte_zero: int, names: list[str], bytes_of=None):
    """(columns, led text, chunk) -> the columns, and the ids of the text; with the bytes of the pieces, also the text of these ids."""

    def ids_of(texts: pa.Array, look: Lookup, own: Lookup, rules) -> pa.Array:
        every = np.concatenate([look.ids, own.ids]) if len(own.ids) else look.ids
        out, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for data, offsets, _ in tk.spans(texts, _PIECE):
            u = Units(data, offsets, rules)
            h = u.hashes()
            first, last = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            at = look.places(h)
            for table, shift, which in ((look, 0, np.flatnonzero(at >= 0)), (own, len(look.ids), np.flatnonzero(at < 0))):
                if len(which):
                    place = at[which] if table is look else own.places(h[which])
                    if (place < 0).any():
                        raise RuntimeError("a unit of the text was not counted: the documents changed between two reads")
                    first[which], last[which] = table.begins[place] + shift, table.ends[place] + shift
            times = last - first
            ends = np.r_[0, np.cumsum(times)]
            out.append(every[np.repeat(first - ends[:-1], times) + np.arange(int(ends[-1]))].astype(np.int32))
            sizes.append(np.diff(ends[u.bounds]))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(out), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, look = rules_of.value, Lookup.load(uri, byte_zero)
        tk.release()  # what the table was built from
        own, of = None, None
        for batch in batches:
            for a, n, chunk in _runs(batch.column(batch.num_columns - 1)):
                if own is None or chunk != of:
                    own, of = Lookup.load(f"{fills}/bucket={chunk % buckets}", byte_zero, chunk), chunk
                for b in range(a, a + n, _ROWS):
                    part = batch.slice(b, min(_ROWS, a + n - b))
                    ids = ids_of(part.column(part.num_columns - 2), look, own, rules)
                    back = [pa.array(decode_lists(ids, *bytes_of.value), pa.string())] if bytes_of else []
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], ids, *back], names=names)

    return run


def encode(docs: DataFrame, table: PieceTable, frequent: int = 1 << 19, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str | None = None) -> DataFrame:
    """The documents with the piece ids of their texts in `ids_col` and, if asked for, the text that these ids decode to."""
    spark = docs.sparkSession
    scratch = tk.Scratch(spark, "pieces")
    rules = spark.sparkContext.broadcast(joins(table))  # 64 KB, and eight bytes a pair
    docs, chunk = tk.chunked(docs, scratch, CHUNK)
    filled, text = docs.where(F.length(F.col(f"`{text_col}`")) > 0), _led(F.col(f"`{text_col}`")).alias("led")
    counted = filled.select(text).mapInArrow(tk.released(_counter(rules)), "hash long, unit string, n long")
    counted = counted.repartition(F.col("hash")).groupBy("hash", "unit").agg(F.sum("n").alias("n"))  # tasks have merged theirs already
    coded = lattice(counted, table).persist(StorageLevel.DISK_ONLY)  # made anew where an executor is lost; gone below
    held = scratch.save(tk.most_frequent(coded, "n", frequent).select("hash", "ids").coalesce(2))  # `frequent` rows at most: about 25 bytes each
    uri, zero = held._tideline_path, table.byte_zero
    wanted = filled.select(text, chunk.alias("chunk")).mapInArrow(tk.released(_rare(rules, uri, zero)), "chunk long, hash long")
    buckets = max(8, -(-coded.count() // _BUCKET))  # a folder is for many chunks, and grows with what a chunk needs
    bucket = F.pmod("chunk", F.lit(buckets)).alias("bucket")
    rare = wanted.distinct().join(coded.select("hash", "ids"), "hash").select("chunk", "hash", "ids", bucket)
    fills = scratch.path("fills")
    rare.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk").write.partitionBy("bucket").parquet(fills)
    coded.unpersist()
    made = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    own = [f for f in docs.schema if f.name not in (ids_col, decoded_col)]
    led, named = tk.fresh(docs, "led", "chunk")
    rows = docs.select(*[F.col(f"`{f.name}`") for f in own], text.alias(led), chunk.alias(named))
    schema = T.StructType([*own, *made])
    bytes_of = spark.sparkContext.broadcast(piece_bytes(table)) if decoded_col else None  # the piece table: fixed
    return rows.mapInArrow(tk.released(_encoder(rules, uri, fills, buckets, zero, schema.names, bytes_of)), schema)


def piece_bytes(table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces, one after another, and their bounds."""
    raw = [bytes([x]) if isinstance(x, int) else x.encode() for x in table.names]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def decode_lists(lists: pa.Array, data: np.ndarray, cuts: np.ndarray) -> list[str | None]:
    """Texts of lists of piece ids: the bytes of their pieces, less the space before the text; null for a null."""
    ids, offsets = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
    n = (cuts[1:] - cuts[:-1])[ids]
    ends = np.r_[0, np.cumsum(n)]
    flat = data[np.repeat(cuts[:-1][ids] - ends[:-1], n) + np.arange(int(ends[-1]))].tobytes()
    at = ends[offsets].tolist()
    texts = [flat[min(a + 1, b) : b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
    return [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)]


def _decoder(of, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                texts = decode_lists(part.column(part.num_columns - 1), *of.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=names)

    return run


def decode(coded: DataFrame, table: PieceTable, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their piece ids in `out_col`; null ids give null, no ids the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(piece_bytes(table))  # the piece table: fixed
    own = [f for f in coded.schema if f.name != out_col]
    rows = coded.select(*[F.col(f"`{f.name}`") for f in own], F.col(f"`{ids_col}`").alias(tk.fresh(coded, "ids")[0]))
    schema = T.StructType([*own, T.StructField(out_col, T.StringType())])
    return rows.mapInArrow(_decoder(shared, schema.names), schema)
