"""Exact Jaccard join of word-shingle sets by vertical partitioning.

The global order of shingle hashes is cut into fragments. Each fragment finds by itself
which of its shingles occur in two different sets and how often; summed over fragments this
leaves the sets that can have a partner at all (at least the threshold's share of their
shingles must occur elsewhere). Candidate pairs share a rare-first prefix and pass the
length and positional filters; their overlaps are counted fragment by fragment and summed
per pair.

Equal sets are one node, so groups of copies never make pairs. Candidates come in two
steps: every bucket first links its members to one pivot, and only pairs that are then
still in different components are joined within the bucket. That spans every component but
leaves out links between sets that are already connected. Where the links themselves are
asked for, all of them are verified: pairs of small buckets one by one, members of hot
buckets block against block, each pair in one of the two only.

Defined cases: a null or blank text has an empty set, is linked with nothing, and is its
own component. Texts of fewer words than a shingle are one shingle of the whole. Rows with
equal ids are separate documents. A component's id is the smallest non-null document id in
it (null where there is none). Columns other than the id and the text are ignored.
Hashes have 64 bits, those inside a fragment 48; equal hashes are taken as equal shingles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components

tk.ship(__name__)


@dataclass(frozen=True)
class JoinRules:
    """Jaccard threshold as a percentage; `postings` is about what one fragment holds.

    Buckets of more than `hot` sets are compared in blocks of about `block` sets and `block_grams` shingles.
    """

    width: int = 5
    percent: int = 75
    postings: int = 4_000_000
    overlap_parts: int = 4
    hot: int = 32
    block: int = 1024
    block_grams: int = 1 << 20


def _set_key(s: np.ndarray) -> int:
    x = tk.mix64(s + np.uint64(0x632BE59BD9B4E019))
    return int(tk.mix64(np.array([x.sum(dtype=np.uint64)]) + np.array([len(s)], np.uint64)).view(np.int64)[0])


def _sizer(width: int, id_field: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], []
            for p in tk.pieces(batch.column(1)):
                for s in tk.shingle_sets(p, width):
                    n.append(len(s))
                    keys.append(_set_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), *batch.columns[2:]], names=[id_field, "n_shingles", "set_key", "text_key"][: batch.num_columns + 1])

    return run


_LOW = 6  # bytes of a hash kept inside a fragment


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_LOW].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, _LOW)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :_LOW] = low
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


_BLOBS = ["keys", "sizes", "counts", "grams"]
_FLUSH = 4_000_000


def _cutter(width: int, fragments: int):
    """Texts -> one packed row a fragment: set keys, set sizes, shingles of each in the fragment, and these."""

    def flush(keys, sizes, sets):
        h = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        frag = _fragment(h, fragments)
        order = np.argsort(frag, kind="stable")
        h, owner, frag = h[order], owner[order], frag[order]
        keys, sizes = np.array(keys, np.int64), np.array(sizes, np.int64)
        rows = []
        cut = np.searchsorted(frag, np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(cut)):
            o = owner[cut[f] : cut[f + 1]]
            head = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            rows.append((int(f), keys[o[head]].tobytes(), sizes[o[head]].astype(np.int32).tobytes(), np.diff(np.r_[head, len(o)]).astype(np.int32).tobytes(), _pack(h[cut[f] : cut[f + 1]])))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["fragment", *_BLOBS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, sets, held, seen = [], [], [], 0, set()
        for batch in batches:
            for p in tk.pieces(batch.column(0)):
                for s in tk.shingle_sets(p, width):
                    if not len(s) or (k := _set_key(s)) in seen:
                        continue
                    seen.add(k)
                    keys.append(k)
                    sizes.append(len(s))
                    sets.append(s)
                    held += len(s)
                    if held >= _FLUSH:
                        yield flush(keys, sizes, sets)
                        keys, sizes, sets, held, seen = [], [], [], 0, set()
        if sets:
            yield flush(keys, sizes, sets)

    return run


def _gather(batches: Iterator[pa.RecordBatch], extra: list[str]) -> dict[int, dict[str, bytes]]:
    """Blobs of a task's rows, joined by their first column."""
    parts: dict = defaultdict(lambda: defaultdict(list))
    for batch in batches:
        for i, f in enumerate(batch.column(0).to_pylist()):
            for j, name in enumerate([*_BLOBS, *extra], 1):
                parts[f][name].append(batch.column(j)[i].as_py())
    return {f: {k: b"".join(v) for k, v in x.items()} for f, x in parts.items()}


def _sharer(buckets: int):
    """A fragment's sets -> its shingles that are in two sets and more, packed by the bucket of the set's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, x in _gather(batches, []).items():
            keys, sizes, counts = np.frombuffer(x["keys"], np.int64), np.frombuffer(x["sizes"], np.int32), np.frombuffer(x["counts"], np.int32)
            _, first, same = np.unique(keys, return_index=True, return_inverse=True)
            use = np.repeat(first[same] == np.arange(len(keys)), counts)  # a set that came twice counts once
            h = _unpack(x["grams"])[use]
            owner = np.repeat(np.arange(len(keys)), counts)[use]
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
            times = np.repeat(np.diff(np.r_[head, len(h)]), np.diff(np.r_[head, len(h)]))
            many = times > 1
            h, owner, times = h[many], owner[many], times[many]
            if not len(h):
                continue
            gram = tk.mix64(h + tk.mix64(np.array([f + 1], np.uint64)))  # the fragment again a part of the hash
            rank = np.minimum(np.log2(times) * 8, 255).astype(np.uint8)  # rarer first, in classes
            order = np.argsort(owner, kind="stable")
            gram, owner, rank = gram[order], owner[order], rank[order]
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            k, n, c = keys[owner[head]], sizes[owner[head]], np.diff(np.r_[head, len(owner)]).astype(np.int32)
            to = (tk.mix64(k.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)):
                mine = order[cut[b] : cut[b + 1]]
                at = np.repeat(head[mine] - np.r_[0, np.cumsum(c[mine])[:-1]], c[mine]) + np.arange(c[mine].sum())
                rows.append((int(b), k[mine].tobytes(), n[mine].tobytes(), c[mine].tobytes(), gram[at].tobytes(), rank[at].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(v, pa.binary()) for v in cols[1:])], names=["bucket", *_BLOBS, "ranks"])

    return run


def _survivor(percent: int):
    """Sums over fragments: the sets of which enough shingles are shared, with these in the order rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gather(batches, ["ranks"]).values():
            keys, sizes, counts = np.frombuffer(x["keys"], np.int64), np.frombuffer(x["sizes"], np.int32), np.frombuffer(x["counts"], np.int32)
            gram, rank = np.frombuffer(x["grams"], np.uint64), np.frombuffer(x["ranks"], np.uint8)
            names, first, place = np.unique(keys, return_index=True, return_inverse=True)
            shared = np.bincount(place, counts).astype(np.int64)
            n = sizes[first].astype(np.int64)
            ok = 100 * shared >= percent * n
            owner = np.repeat(place, counts)
            use = ok[owner]
            owner, gram, rank = owner[use], gram[use], rank[use]
            order = np.lexsort((gram, rank, owner))
            gram = gram[order].view(np.int64)
            alive = np.flatnonzero(ok)
            offsets = np.r_[0, np.cumsum(shared[alive])].astype(np.int32)
            for a in range(0, len(alive), 2000):
                b = min(a + 2000, len(alive))
                lists = pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a], pa.int32()), pa.array(gram[offsets[a] : offsets[b]], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(names[alive[a:b]], pa.int64()), pa.array(n[alive[a:b]], pa.int64()), lists], names=["set_key", "n", "grams"])

    return run


def _spread(df: DataFrame, parts: int, column: str) -> DataFrame:
    """Deal whole-number ids out to as many tasks, one each."""
    return df.repartitionById(parts, F.col(column)) if hasattr(df, "repartitionById") else df.repartition(parts, column)


def _verified(pairs: DataFrame, sets: DataFrame, rules: JoinRules) -> DataFrame:
    """(a, b) of the candidates (a, b, na, nb) that meet the threshold: overlaps per part of the order, summed per pair."""
    v = rules.overlap_parts
    parts = sets.select("set_key", F.explode(F.sequence(F.lit(0), F.lit(v - 1))).alias("part"), "grams").select(
        "set_key", "part", F.expr(f"filter(grams, g -> pmod(g, {v}) = part)").alias("grams")
    )
    wanted = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(v - 1))))
    left = parts.select(F.col("set_key").alias("a"), "part", F.col("grams").alias("ga"))
    right = parts.select(F.col("set_key").alias("b"), "part", F.col("grams").alias("gb"))
    counted = wanted.join(right, ["b", "part"]).join(left, ["a", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("c"))
    return counted.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")).where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * rules.percent).select("a", "b")


def _may_link(na, nb, ra, rb, percent: int):
    """Length and positional filters; r: shingles from the shared one on, in the order."""
    need = (na + nb) * percent  # overlap * (100 + percent) must reach it
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(ra, rb) * (100 + percent) >= need)


_COLUMNS = 2048  # shingles of one matrix product


def _block_links(percent: int, pairs: bool):
    """The sets of two blocks, or of one -> their links (a, b), or the number of links of each set."""

    def side(table: pa.Table, which: int):
        t = table.filter(pc.equal(table["side"], which)).combine_chunks()
        grams = t["grams"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64()))
        n = t["n"].to_numpy().astype(np.int64)
        return t["set_key"].to_numpy(), n, np.repeat(np.arange(len(n)), grams.value_lengths().to_numpy(zero_copy_only=False)), grams.flatten().to_numpy()

    def run(table: pa.Table) -> pa.Table:
        ka, na, ra, ga = side(table, 0)
        kb, nb, rb, gb = side(table, 1)
        one = not len(kb)
        if one:
            kb, nb, rb, gb = ka, na, ra, ga
        both = np.intersect1d(ga, gb)
        overlap = np.zeros((len(ka), len(kb)), np.int32)
        at, bt = np.searchsorted(both, ga), np.searchsorted(both, gb)
        at[np.append(both, 0)[at] != ga] = len(both)
        bt[np.append(both, 0)[bt] != gb] = len(both)
        oa, ob = np.argsort(at, kind="stable"), np.argsort(bt, kind="stable")
        for c in range(0, len(both), _COLUMNS):
            e = min(c + _COLUMNS, len(both))
            x, y = np.zeros((len(ka), e - c), np.float32), np.zeros((len(kb), e - c), np.float32)
            for m, o, t, r in ((x, oa, at, ra), (y, ob, bt, rb)):
                held = o[np.searchsorted(t[o], c) : np.searchsorted(t[o], e)]
                m[r[held], t[held] - c] = 1
            overlap += (x @ y.T).astype(np.int32)
        ok = overlap.astype(np.int64) * (100 + percent) >= (na[:, None] + nb[None, :]) * percent
        if one:
            ok = np.triu(ok, 1)
        if pairs:
            i, j = np.nonzero(ok)
            return pa.table({"a": pa.array(ka[i], pa.int64()), "b": pa.array(kb[j], pa.int64())})
        keys, times = np.r_[ka, kb], np.r_[ok.sum(1), ok.sum(0)]
        return pa.table({"node": pa.array(keys[times > 0], pa.int64()), "n_links": pa.array(times[times > 0], pa.int64())})

    return run


def _partners(early: DataFrame, postings: DataFrame, rules: JoinRules, *also) -> DataFrame:
    """Candidates (a, b, na, nb) of buckets, smaller set first, each once; `also`: conditions on x and y."""
    x, y = early.alias("x"), postings.alias("y")
    on = (F.col("x.gram") == F.col("y.gram")) & (F.struct("x.n", "x.set_key") < F.struct("y.n", "y.set_key"))
    on &= _may_link(F.col("x.n"), F.col("y.n"), F.col("x.rest"), F.col("y.rest"), rules.percent)
    for c in also:
        on &= c
    found = x.join(y, on)
    return found.select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def _early(postings: DataFrame, rules: JoinRules) -> DataFrame:
    """The smaller set of a link has its shared shingle early enough, so only such postings look for partners."""
    return postings.where(F.col("rest") * (100 + rules.percent) >= 2 * rules.percent * F.col("n"))


def _every_link(postings: DataFrame, alive: DataFrame, rules: JoinRules, scratch: tk.Scratch, pairs: bool) -> DataFrame:
    """All links (a, b) between different sets, or (node, n_links).

    Sets of hot buckets are dealt into blocks by the largest of these buckets; two blocks with a hot
    bucket in common are compared whole. Pairs of small buckets count where their blocks are not.
    """
    hot = postings.where(F.col("size") > rules.hot)
    home = hot.groupBy("set_key").agg(F.max(F.struct("size", "gram"))["gram"].alias("home"))
    members = alive.join(home, "set_key").select("set_key", "home", F.size("grams").alias("m"))
    split = members.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / rules.block, F.sum("m") / rules.block_grams)).alias("blocks"))
    block = F.struct("home", F.pmod(F.xxhash64("set_key"), F.col("blocks")).alias("i")).alias("block")
    placed = scratch.save(members.join(split, "home").select("set_key", block))
    touched = hot.join(placed, "set_key").select("gram", "block").distinct()
    x, y = touched.select("gram", F.col("block").alias("x")), touched.select("gram", F.col("block").alias("y"))
    met = scratch.save(x.join(y, "gram").where(F.col("x") <= F.col("y")).select("x", "y").distinct())
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("block")), F.struct(F.lit(1).alias("side"), F.col("y").alias("block")))
    sides = met.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.slice(ends, 1, 1)).otherwise(ends)).alias("end")).select("x", "y", "end.side", "end.block")
    sent = sides.join(placed.join(alive, "set_key"), "block").select("x", "y", "side", "set_key", "n", "grams")
    near = sent.groupBy("x", "y").applyInArrow(_block_links(rules.percent, pairs), "a long, b long" if pairs else "node long, n_links long")
    small = postings.where(F.col("size") <= rules.hot)
    alone = _partners(_early(small, rules), small, rules)
    for end in ("a", "b"):
        alone = alone.join(placed.select(F.col("set_key").alias(end), F.col("block").alias(f"block_{end}")), end, "left")
    seen = (F.least("block_a", "block_b") == F.col("x")) & (F.greatest("block_a", "block_b") == F.col("y")) & F.col("block_a").isNotNull() & F.col("block_b").isNotNull()
    alone = _verified(alone.join(met, seen, "left_anti").select("a", "b", "na", "nb"), alive, rules)
    if pairs:
        out = scratch.save(near.unionByName(alone))
    else:
        one = alone.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n_links"))
        out = scratch.save(near.unionByName(one).groupBy("node").agg(F.sum("n_links").alias("n_links")))
    scratch.drop(placed, met)
    return out


@dataclass(frozen=True)
class Linked:
    """sets: (id, n_shingles, set_key) a document; nodes: (set_key, component) of sets in links; links: as asked for."""

    sets: DataFrame
    nodes: DataFrame
    links: DataFrame | None
    scratch: tk.Scratch


def link(docs: DataFrame, rules: JoinRules | None = None, id_col: str = "doc_id", text_col: str = "text", want: str = "counts") -> Linked:
    """Sizes of all sets, the components of the sets that are linked with another set, and all links.

    want: "counts" gives links as (node, n_links), "pairs" as (a, b) of set keys; "groups" gives none of
    them, verifies only the links that the components need, and adds a text_key to `sets`.
    """
    rules = rules or JoinRules()
    spark = docs.sparkSession
    scratch = tk.Scratch(spark, "ngramjoin")
    kind = docs.schema[id_col].dataType.simpleString()
    key, key_kind = ([tk.text_key(F.col(text_col))], ", text_key string") if want == "groups" else ([], "")
    sets = scratch.save(docs.select(F.col(id_col), F.col(text_col), *key).mapInArrow(tk.released(_sizer(rules.width, id_col)), f"`{id_col}` {kind}, n_shingles long, set_key long{key_kind}"))
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rules.postings))
    blobs = "keys binary, sizes binary, counts binary, grams binary"
    cut = docs.select(F.col(text_col)).mapInArrow(tk.released(_cutter(rules.width, fragments)), f"fragment int, {blobs}")
    shared = _spread(cut, fragments, "fragment").mapInArrow(tk.released(_sharer(fragments)), f"bucket int, {blobs}, ranks binary")
    alive = scratch.save(_spread(shared, fragments, "bucket").mapInArrow(tk.released(_survivor(rules.percent)), "set_key long, n long, grams array<bigint>"))
    prefix = alive.withColumn("need", F.ceil(F.col("n") * rules.percent / 100)).select(
        "set_key", "n", F.size("grams").alias("m"), F.posexplode(F.slice("grams", 1, (F.size("grams") - F.col("need") + 1).cast("int"))).alias("pos", "gram")
    )
    prefix = prefix.select("gram", "set_key", "n", (F.col("m") - F.col("pos")).cast("long").alias("rest"), (F.col("m") / F.col("n")).alias("share"))
    # Step one: each bucket's members with its pivot, the set of which the largest share is shared.
    pivot = prefix.groupBy("gram").agg(F.max(F.struct("share", "n", "set_key", "rest")).alias("p"), F.count("*").alias("size")).where("size > 1")
    postings = scratch.save(prefix.join(pivot, "gram"))
    stars = postings.where(F.col("set_key") != F.col("p.set_key")).where(_may_link(F.col("n"), F.col("p.n"), F.col("rest"), F.col("p.rest"), rules.percent))
    stars = stars.select(F.col("p.set_key").alias("a"), F.col("set_key").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb")).distinct()
    links = scratch.save(_verified(stars, alive, rules))
    nodes = components(links, scratch)
    # Step two: in buckets of several components, pairs across them.
    label = F.coalesce("component", "set_key").alias("label")
    marked = postings.join(nodes, postings["set_key"] == nodes["node"], "left").select("gram", "set_key", "n", "rest", label)
    mixed = marked.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram")
    marked = scratch.save(marked.join(mixed, "gram"))
    rest = _partners(_early(marked, rules), marked, rules, F.col("x.label") != F.col("y.label"))
    more = scratch.save(_verified(rest, alive, rules))
    both = links.unionByName(more)
    if more.limit(1).count():
        nodes = components(both, scratch)
    every = None if want == "groups" else _every_link(postings, alive, rules, scratch, want == "pairs")
    scratch.drop(postings, marked, alive)
    return Linked(sets, nodes, every, scratch)


def join_components(docs: DataFrame, rules: JoinRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every document; n_links: other sets that its set is linked with, all of them verified."""
    linked = link(docs, rules, id_col, text_col)
    sets = linked.sets
    classes = sets.where("n_shingles > 0").groupBy("set_key").agg(F.min(id_col).alias("least"), F.count("*").alias("copies"))
    nodes = linked.nodes.join(linked.links, "node", "left").withColumnRenamed("node", "set_key")
    known = classes.join(nodes, "set_key", "left")
    grouped = known.where("component is not null").groupBy("component").agg(F.min("least").alias("group_least"))
    # Only sets with a copy or a link need a lookup; all others are their own component.
    known = known.where("copies > 1 or component is not null").join(grouped, "component", "left")
    known = known.select(F.col("set_key").alias("k"), F.coalesce("group_least", "least").alias("known_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sets.join(known, sets["set_key"] == known["k"], "left")
    return out.select(F.col(id_col), "n_shingles", F.coalesce("known_id", F.col(id_col)).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, rules: JoinRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (null last), then of the smallest text hash; of rows equal in both, any one."""
    linked = link(docs, rules, id_col, text_col, "groups")
    sets = linked.sets.where("n_shingles > 0").join(linked.nodes, F.col("set_key") == F.col("node"), "left")
    texts = sets.groupBy(F.coalesce("component", "set_key").alias("in_group"), F.col(id_col).alias("k_id"), F.col("text_key").alias("k_text")).agg(F.count("*").alias("times"))
    rank = F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_text")
    best = texts.groupBy("in_group").agg(F.min(rank).alias("best"), F.sum("times").alias("held")).where("held > 1").select(F.col("in_group").alias("best_of"), "best")
    decided = linked.scratch.save(texts.join(best, F.col("in_group") == F.col("best_of")).select("k_id", "k_text", ((rank == F.col("best")) & (F.col("times") == 1)).alias("stays"), ((rank == F.col("best")) & (F.col("times") > 1)).alias("repeated")))
    gone, repeated = decided.where("not stays").select("k_id", "k_text"), linked.scratch.save(decided.where("repeated").select("k_id", "k_text"))
    same = lambda keys: docs[id_col].eqNullSafe(keys["k_id"]) & (tk.text_key(docs[text_col]) == keys["k_text"])
    once = docs.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(gone, same(gone), "left_anti").unionAll(once)
