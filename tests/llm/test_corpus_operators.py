"""WARC, sharding, decontamination, language model, n-gram join, pieces, pipeline."""

import base64
import hashlib
import io
import math
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontam, lm, ngramjoin, oracles, pieces, registry, sharding, warc
from tideline.llm import textkit as tk
from tideline.llm.components import components

SF = "/root/testdata/sf0.001"
MODEL = f"{registry.TOKENIZERS}/piece_bpe_32k.model"


# --- WARC ---


def test_warc_round_trip_and_dedup(spark, tmp_path):
    rows = [(3, "http://a/é b", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 9000), (None, "http://f", "only"), (7, "http://g", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "page_id long, url string, html string, refers_to int, _salt int, payload string").repartition(3)
    root = f"file://{tmp_path}/p"
    packages = tk.Scratch(spark, "t").save(warc.write_archives(pages, root))
    got = {r["record_id"]: r for r in warc.read_archives(packages, root).collect()}
    assert len(got) == len(rows) == packages.agg(F.sum("records")).first()[0]
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault((h or "").encode(), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        r = got[None if i is None else str(i)]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if first[raw] == i:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == raw
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == str(first[raw])
    none = tk.Scratch(spark, "t").save(warc.write_archives(pages.where("false"), root))
    assert warc.read_archives(none, root).count() == 0
    small = tk.Scratch(spark, "t").save(warc.write_archives(pages, f"{root}2", min_revisit=100))
    assert warc.read_archives(small, f"{root}2").where("record_type = 'revisit'").count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    body = [("a.bin", b"one" * 10), ("b/é.bin", b""), ("c.bin", bytes(range(256)) * 300)]
    out, members = io.BytesIO(), []
    for name, data in body:
        members.append((name, zlib.crc32(data), len(data), out.tell()))
        out.write(warc.local_header(name, zlib.crc32(data), len(data)) + data)
    out.write(warc.directory(members, out.tell(), zip64))
    raw = out.getvalue()
    z = warc.ZipReader(lambda a, n: raw[a : a + n], len(raw))
    for name, data in body:
        at, n = z.locate(name)
        assert raw[at : at + n] == data
    with zipfile.ZipFile(io.BytesIO(raw)) as other:  # and others can read it
        assert [other.read(n) for n, _ in body] == [d for _, d in body] and other.testzip() is None


def test_zip_made_by_others_with_a_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", b"stored")
        z.writestr("y", b"y" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 not the end"
    raw = out.getvalue()
    r = warc.ZipReader(lambda a, n: raw[a : a + n], len(raw))
    at, n = r.locate("x")
    assert raw[at : at + n] == b"stored"
    with pytest.raises(ValueError, match="compressed"):
        r.locate("y")
    with pytest.raises(ValueError, match="no end"):
        warc.ZipReader(lambda a, n: b"junk"[a : a + n], 4)


def test_index_lines_are_sorted_and_complete():
    lines = warc.index_lines([("1", "http://www.B.example/x y?q=1", "response", 0, 10), ("2", "http://a.example", "revisit", 10, 5), ("3", "http://[bad", "response", 15, 2)]).decode().splitlines()
    assert [x.split(" ")[0] for x in lines] == ["example,a)/", "example,b,www)/x%20y?q=1", "http://[bad"] and lines == sorted(lines)
    assert all(x.split(" ")[1] == "19700101000000" for x in lines)
    import json

    assert sorted((int(e["offset"]), int(e["length"])) for e in (json.loads(x.split(" ", 2)[2]) for x in lines)) == [(0, 10), (10, 5), (15, 2)]


def test_damaged_records_are_told():
    with pytest.raises(ValueError):
        warc.parse_record(b"nonsense")
    good = warc.record("response", "u", "1", "D", b"abc", 3, None)
    with pytest.raises(ValueError, match="cut short"):
        warc.parse_record(good[:-8])


# --- sharding ---


def test_sharding_law(spark, odd, odd_rows, empty):
    out = sharding.shard(odd, 4, 64).placed.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 4)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = defaultdict(set)
    for r in out + sharding.shard(odd.where("doc_id % 2 = 0"), 4, 64).placed.collect():
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(v) == 1 for v in by_id.values())
    five = {r["doc_id"]: r["shard"] for r in sharding.shard(odd, 5, 64).placed.collect()}
    assert all(five[r["doc_id"]] == r["grown_shard"] for r in out)
    assert sharding.shard(empty, 4, 64).placed.count() == 0


def test_the_stored_map_is_loaded_and_edited(spark, odd, tmp_path):
    root = f"file://{tmp_path}/map"
    one = sharding.shard(odd, 4, 64, root=root)
    assert one.maps.versions() == [1, 2, 3] and (one.base, one.grown, one.even) == (1, 2, 3)
    first = {r["doc_id"]: (r["shard"], r["rebalanced_shard"]) for r in one.placed.collect()}
    two = sharding.shard(odd, 4, 64, root=root)  # goes on from the rebalanced map
    assert two.maps.versions() == [1, 2, 3, 4, 5]
    assert {r["doc_id"]: r["shard"] for r in two.placed.collect()} == {k: v[1] for k, v in first.items()}
    base, even = one.maps.load(1), one.maps.load(3)
    assert set(even.moved) == {s for s in range(64) if base.owner[s] != even.owner[s]}
    load = Counter()
    for r in one.placed.collect():
        load[r["rebalanced_shard"]] += r["size"]
    before = Counter()
    for r in one.placed.collect():
        before[r["shard"]] += r["size"]
    assert max(load.values()) <= max(before.values())
    with pytest.raises(ValueError):
        sharding.shard(odd, 5, 64, root=root)
    with pytest.raises(Exception, match="(?i)exist"):
        one.maps.save(base, {})
    sharding.write_shards(odd, one, f"{tmp_path}/out", columns=["doc_id", "text"])
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == odd.count() and {(r["doc_id"], r["shard"]) for r in got.collect()} == {(k, v[0]) for k, v in first.items()}


def test_a_hot_key_is_split(spark):
    docs = spark.createDataFrame([(1, "same")] * 500 + [(1, f"t{i}") for i in range(300)] + [(i, "x") for i in range(200)], "doc_id int, text string")
    out = sharding.shard(docs, 3, 32).placed
    assert out.count() == 1000
    for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r["n"] == r["d"] == r["m"] + 1


def test_maps_are_edited_not_rebuilt():
    m = sharding.SlotMap.fresh(4096, 16)
    sizes = Counter(m.owner)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    g = m.grown()
    assert {g.owner[s] for s in g.moved} == {16} and len(g.moved) == 4096 // 17
    assert all(a == b for i, (a, b) in enumerate(zip(m.owner, g.owner, strict=True)) if i not in set(g.moved))
    rng = random.Random(1)
    load = {s: rng.randint(1, 100) ** 2 for s in range(4096)}
    even = m.rebalanced(load)
    per = Counter()
    for s, o in enumerate(even.owner):
        per[o] += load[s]
    assert max(per.values()) <= 1.03 * sum(per.values()) / 16 and len(even.moved) < 1000


# --- decontamination ---


def infix(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        cur = [i]
        for j, e in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != e), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_decontamination_equals_brute_force(spark, words):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for i in range(12)] + [(96, " .,"), (97, "Short answer: 42"), (98, None), (99, "short")]
    docs = []
    for d in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        if d % 2:
            t = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(t) // 9)):
                i = rng.randrange(len(t))
                t[i : i + rng.choice([0, 1])] = rng.choice(["", "x", "Q"])
            text += " " + "".join(t).upper() + ", " + " ".join(rng.choice(words) for _ in range(20))
        docs.append((d, text))
    docs += [(60, None), (61, ""), (62, "  Short!"), (63, "so: short ANSWER 42."), (64, "short answer 421 is not it, but short answer 42 is"), (65, "a short answer 421, short"), (66, "xshort answer 42")]
    rules = decontam.SearchRules()
    index = decontam.build([t for _, t in items], rules)
    want = {(62, 99), (63, 97), (64, 97)}
    for d, text in docs:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        x, _ = decontam.normalise(raw, np.array([0]))
        for k in np.flatnonzero(~index.exact):
            if len(x) and infix(index.rows[k, : index.lengths[k]].tolist(), x.tolist()) <= index.edits[k]:
                want.add((d, items[index.of[k]][0]))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("edits", F.lit("clash"))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"begin": F.lit(1), "item_id": F.lit(5)})
    for limit in (8 << 20, 300):  # one block, and several
        got = decontam.find_passages(table, bench, decontam.SearchRules(block_bytes=limit)).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert len(want) >= 25
    kept = {r["doc_id"] for r in decontam.drop_contaminated(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.find_passages(table, bench.where("false")).count() == 0
    assert decontam.find_passages(table.where("false"), bench).count() == 0


def test_decontamination_with_common_words(spark, monkeypatch):
    """Items and documents of few words: every q-gram stands in most patterns, and slices must lose nothing."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["the answer", "of the", "question is", "the"]) for _ in range(n))
    items = [(i, say(rng.randint(12, 30))) for i in range(10)]
    docs = [(d, say(8) + " " + (items[d][1] if d % 2 else "") + " " + say(8)) for d in range(10)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = []
    for spread, rules in ((1 << 21, {}), (1 << 15, {"index_bytes": 540_000})):
        monkeypatch.setattr(decontam, "SPREAD", spread)
        out = decontam.find_passages(table, bench, decontam.SearchRules(**rules)).collect()
        got.append(sorted((r["doc_id"], r["item_id"], r["edits"], r["windows"]) for r in out))
    assert got[0] == got[1]
    assert {(d, d) for d in range(1, 10, 2)} <= {r[:2] for r in got[0]}
    large = [(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 9999)) for _ in range(40))) for _ in range(3000)]
    indexes = list(decontam._indexes(list(enumerate(large)), decontam.SearchRules()))
    assert all(index.size() <= decontam.SearchRules().index_bytes for _, index in indexes) and sum(len(i) for i, _ in indexes) == 3000


# --- language model ---


def test_language_model_counts_and_probabilities(spark, odd, odd_rows, empty):
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    train = odd.where("doc_id % 3 <> 0 or doc_id is null")
    scratch = tk.Scratch(spark, "t")
    for frequent in (1 << 16, 3):  # all tokens in the table, and nearly all joined
        model, counts = lm.fit(train, scratch, lm.ModelSettings(frequent=frequent, batch=256))
        c = Counter(w for i, t, _ in odd_rows if i is None or i % 3 for w in tokens(t))
        n, v = sum(c.values()), len(c)
        want = Counter((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in odd_rows)
        out = lm.score(odd, model, counts, scratch).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
        assert all(r["score"] < 0 for r in out)
    assert lm.score(empty, model, counts, scratch).count() == 0
    nothing, none = lm.fit(empty, scratch)
    assert lm.score(odd, nothing, none, scratch).where("train_tokens = 0 and n_known = 0").count() == odd.count()


def plain_scores(model, counts, texts):
    """log10 probability of each text, token by token, from the weights and the definition alone."""
    s, out = model.settings, []
    words, rows, mass = lm.Words(*model.words()), lm.Rows.of(model.settings), defaultdict(int)
    for w, c in counts.items():
        mass[plain_leaf(words, w)] += c + 1
    for t in texts:
        tokens, total = [*(t or "").encode().lower().split(), b""], 0.0
        leaves = [plain_leaf(words, w) for w in tokens]
        past = [s.fan**2] * 3 + leaves
        for i, (w, leaf) in enumerate(zip(tokens, leaves, strict=True)):
            a, b, c = past[i + 2], past[i + 1], past[i]
            k = leaf // s.fan
            pair = max(1, ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 13) & (s.rows - 1))
            z1 = sum(model.w1[r].astype(float) for r in (0, rows.one[0][a], rows.one[1][b], rows.one[2][c], pair))
            z2 = sum(model.w2[r].astype(float) for r in (rows.alone[k], rows.two[0][k, a], rows.two[1][k, b]))
            p = np.exp(z1)[k] / np.exp(z1).sum() * np.exp(z2)[leaf % s.fan] / np.exp(z2).sum()
            total += math.log10(p) + math.log10((counts.get(w, 0) + 1) / (mass[leaf] + 1))
        out.append(total)
    return out


def plain_leaf(words, w):
    import pyarrow as pa

    p = next(iter(tk.pieces(pa.array([w.decode()], pa.string()))))
    h, _, affix, _ = lm.sequence(p)
    return int(words.leaves(words.look_up(h[:1]), affix[:1])[0])


def test_language_model_scores_equal_the_definition(spark, odd, odd_rows):
    train = odd.where("doc_id % 3 <> 0 or doc_id is null")
    scratch = tk.Scratch(spark, "t")
    counts = Counter(w for i, t, _ in odd_rows if i is None or i % 3 for w in [*(t or "").encode().lower().split(), b""])
    some = [r for r in odd_rows if len(r[1] or "") < 3000]
    for settings in (lm.ModelSettings(batch=256), lm.ModelSettings(frequent=5, batch=64)):
        model, table = lm.fit(train, scratch, settings)
        assert np.abs(model.w1).sum() > 0 and np.abs(model.w2).sum() > 0
        want = Counter((i, round(x, 2)) for (i, _, _), x in zip(some, plain_scores(model, counts, [t for _, t, _ in some]), strict=True))
        short = odd.where("coalesce(length(text), 0) < 3000")
        assert Counter((r["doc_id"], round(r["score"], 2)) for r in lm.score(short, model, table, scratch).collect()) == want


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    w = rng.normal(size=(40, 8)).astype(np.float32)
    rows, target = [rng.integers(1, 40, 300) for _ in range(3)], rng.integers(0, 8, 300)

    def loss(v):
        z = v[rows[0]] + v[rows[1]] + v[rows[2]] + v[0]
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return -z[np.arange(300), target].mean()

    g = lm.gradient(w, rows, target, True)
    for r, k in [(0, 0), (0, 5), (3, 2), (17, 7), (39, 1)]:
        up, down = w.astype(float), w.astype(float)
        up[r, k] += 1e-5
        down[r, k] -= 1e-5
        assert g[r, k] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_language_model_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"the cat {w} on the {w} mat") for i, w in enumerate(["sat", "lay", "sat", "is"] * 30)], "doc_id int, text string")
    scratch = tk.Scratch(spark, "t")
    model, table = lm.fit(docs, scratch, lm.ModelSettings(batch=64))
    counts = Counter(w for r in docs.collect() for w in [*r["text"].encode().split(), b""])
    words = lm.Words(*model.words())
    # After "the cat": all known next tokens, "unknown" in their leaves, and the other leaves' whole share.
    before = plain_scores(model, counts, ["the cat"])[0]
    end = [w for w in counts if w]
    leaves = {w: plain_leaf(words, w) for w in counts}
    s, rows = model.settings, lm.Rows.of(model.settings)
    a, b, c = leaves[b"cat"], leaves[b"the"], s.fan**2
    pair = max(1, ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 13) & (s.rows - 1))
    z1 = sum(model.w1[r].astype(float) for r in (0, rows.one[0][a], rows.one[1][b], rows.one[2][c], pair))
    total = 0.0
    for k in range(s.fan):
        z2 = sum(model.w2[r].astype(float) for r in (rows.alone[k], rows.two[0][k, a], rows.two[1][k, b]))
        share = np.exp(z1)[k] / np.exp(z1).sum() * np.exp(z2) / np.exp(z2).sum()
        for j in range(s.fan):
            own = [w for w in counts if leaves[w] == k * s.fan + j]
            mass = sum(counts[w] + 1 for w in own) + 1
            total += share[j] * (sum(counts[w] + 1 for w in own) + 1) / mass
    assert total == pytest.approx(1, abs=1e-6) and before < 0 and end


def test_language_model_beats_its_base_on_held_out_text(spark):
    r = registry.op4_maxent(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


# --- n-gram join ---


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return Counter((k, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_ngram_join_equals_all_pairs(spark, odd, odd_rows, empty, words):
    got = Counter(tuple(r) for r in ngramjoin.join_components(odd).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute([(i, t) for i, t, _ in odd_rows])
    assert ngramjoin.join_components(empty).count() == 0


@pytest.mark.parametrize("postings", [4_000_000, 300])
def test_ngram_join_on_groups_of_edited_copies(spark, words, postings):
    rng = random.Random(21)
    passage = [rng.choice(words) for _ in range(50)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(12, 90))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngramjoin.join_components(docs, ngramjoin.JoinRules(postings=postings)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)
    assert {r["doc_id"] for r in ngramjoin.keep_one(docs).collect()} == {c for _, _, c in got}


@pytest.mark.parametrize("rules", [{}, {"hot": 3, "block": 4}, {"hot": 1, "block_grams": 100}, {"hot": 6, "block": 1000}])
def test_ngram_join_counts_every_link(spark, words, rules):
    rng = random.Random(22)
    rows = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(2, 40)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(base[:3])
            rows.append((len(rows), " ".join(w)))
    sets = {frozenset(sets_of(t)) for _, t in rows}
    near = {s: sum(s is not o and 100 * len(s & o) >= 75 * len(s | o) for o in sets) for s in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in ngramjoin.join_components(docs, ngramjoin.JoinRules(**rules)).collect()}
    assert got == {i: near[frozenset(sets_of(t))] for i, t in rows} and max(got.values()) > 10
    pairs = [frozenset((r["a"], r["b"])) for r in ngramjoin.link(docs, ngramjoin.JoinRules(**rules), want="pairs").links.collect()]
    assert len(set(pairs)) == len(pairs) == sum(near.values()) // 2


def test_ngram_join_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = Counter(tuple(r) for r in con.execute(f"select doc_id, n_shingles, component_id from ({oracles.OP8})").fetchall())
    assert Counter(tuple(r) for r in registry.op8_ngram_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect()) == want


def test_rows_are_kept_and_dropped_by_id_and_text(spark, words):
    rng = random.Random(6)
    one, two, three, four, item = (" ".join(rng.choice(words) for _ in range(40)) for _ in range(5))
    rows = [(1, one), (1, one), (1, two), (2, one), (None, three), (None, three), (None, four), (None, two + " end"), (3, None), (3, None), (4, three + " end"), (5, "")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, k_text string").repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in ngramjoin.keep_one(docs).collect())
    assert kept == Counter([(1, one), (1, two), (None, four), (4, three + " end"), (3, None), (3, None), (5, "")])
    none = Counter((r["doc_id"], r["text"]) for r in ngramjoin.keep_one(docs.where("doc_id is null and text <> 'x'")).collect())
    assert none == Counter([(None, three), (None, four), (None, two + " end")])
    held = [(None, four), (None, item), (7, three), (7, "and " + item), (None, None), (8, "")]
    clean = decontam.drop_contaminated(spark.createDataFrame(held, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter([(None, four), (7, three), (None, None), (8, "")])


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    order = list(range(200))
    rng.shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(99)] + [(order[i], order[i + 1]) for i in range(100, 199)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), tk.Scratch(spark, "t")).collect()}
    assert got == {x: min(order[:100]) for x in order[:100]} | {x: min(order[100:]) for x in order[100:]}


def test_components_of_a_shuffled_chain_of_thousands(spark):
    order = list(range(4000))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    scratch = tk.Scratch(spark, "t")
    assert {r["component"]: r["n"] for r in components(links, scratch).groupBy("component").agg(F.count("*").alias("n")).collect()} == {0: 4000}
    assert scratch.count <= 2 + 3 * 20  # tables of 20 rounds


# --- pieces ---


_RULES: dict = {}


def rules_of(table):
    if id(table) not in _RULES:
        score = {p: (i, s) for p, i, s in table.pieces}
        _RULES[id(table)] = table, score, min(s for _, _, s in table.pieces) - 10, max(map(len, score)), table.pairs()
    return _RULES[id(table)][1:]


def plain_viterbi(unit, table):
    """Best path over the whole text, with no cuts: largest score, then fewest edges, then the longer last piece."""
    score, low, longest, _ = rules_of(table)
    best = [(0.0, 0, None, None)] + [None] * len(unit)
    for e in range(1, len(unit) + 1):
        for s in range(max(0, e - longest), e):
            if unit[s:e] in score:
                i, w = score[unit[s:e]]
                ids = [i]
            elif e == s + 1:
                ids, w = [b + table.byte_zero for b in unit[s:e].encode()], low
            else:
                continue
            new = (best[s][0] + w, best[s][1] + 1, s, ids)
            if best[e] is None or new[0] > best[e][0] or (new[0] == best[e][0] and new[1] < best[e][1]):
                best[e] = new
    out, at = [], len(unit)
    while at:
        out.append(best[at][3])
        at = best[at][2]
    return [i for ids in reversed(out) for i in ids]


def cut_units(text, table):
    pairs, out = rules_of(table)[3], [" "]
    for a, b in zip(" " + text, text, strict=False):
        if a + b in pairs:
            out[-1] += b
        else:
            out.append(b)
    return out


@pytest.mark.parametrize("frequent", [1 << 19, 60])
def test_pieces_equal_a_plain_viterbi_and_round_trip(spark, odd, odd_rows, empty, frequent, tmp_path):
    table = pieces.PieceTable.load(MODEL)
    long = [(200, "xx" * 3000 + "²." + " " * 900 + "end"), (201, "ab" * 900), (202, "\ufeff\U0010ffff👩‍👩‍👧 ▁▁ \x00")]
    more = spark.createDataFrame([(i, t, "z", [1]) for i, t in long], "doc_id long, text string, decoded string, piece_ids array<int>")
    rows = odd.unionByName(more, allowMissingColumns=True).withColumns({"led": F.lit(1), "chunk": F.lit("c"), "hash": F.lit(2), "r_units": F.lit(3)})
    rows.write.parquet(f"{tmp_path}/rows")
    for docs in (rows, spark.read.parquet(f"{tmp_path}/rows")):  # one that is no file, and one that is
        out = pieces.encode(docs, table, frequent, decoded_col="decoded").collect()
        want = odd_rows + [(*r, None) for r in long]
        assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i, t) for i, t, _ in want)
        assert all((r["text"] or "") == r["decoded"] for r in out) and out[0]["led"] == 1 and out[0]["chunk"] == "c"
        known: dict = {}
        for r in out:
            got = []
            for u in cut_units(r["text"], table) if r["text"] else []:
                if u not in known:
                    known[u] = plain_viterbi(u, table)
                got += known[u]
            assert r["piece_ids"] == got
            if r["text"] and len(r["text"]) < 500:  # the cuts lose nothing
                assert got == plain_viterbi(" " + r["text"], table)
    assert pieces.encode(empty, table).count() == 0
    none = pieces.decode(spark.createDataFrame([(None,), ([],)], "piece_ids array<int>"), table).collect()
    assert [r["decoded"] for r in none] == [None, ""]


def test_both_folds_are_one(spark, words, monkeypatch):
    table = pieces.PieceTable.load(MODEL)
    units = [w + v for w, v in zip(words[:300], words[300:600], strict=True)] + ["q" * 700, " " * 40 + "word", "é", "\u2581"]
    rows = spark.createDataFrame([(i, u, 1) for i, u in enumerate(units)], "hash long, unit string, n long")
    got = []
    for short in (1 << 30, 0):
        monkeypatch.setattr(pieces, "_SHORT", short)
        got.append({r["hash"]: r["ids"] for r in pieces.lattice(rows, table).collect()})
    assert got[0] == got[1] and len(got[0]) == len(units)


def test_no_worker_keeps_a_table(spark):
    import sys

    registry.op10_sentencepiece(spark, SF).write.format("noop").mode("overwrite").save()

    def held(batches):
        import pyarrow as pa

        kept = vars(sys).get("_tideline_kept", {})
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in kept], pa.string())], names=["k"])

    keys = {r["k"] for r in spark.range(64).repartition(16).mapInArrow(held, "k string").collect()}
    assert all(k.startswith("('powers'") for k in keys), keys


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = tk.table(spark, SF, "documents")
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "pieces"]
    rows, held = docs, docs.count()
    for name, stage in cp.STAGES:
        rows = tk.Scratch(spark, "t").save(stage(spark, rows, SF))
        assert set(docs.columns) <= set(rows.columns) and (name == "pieces" or rows.columns == docs.columns)
        assert 0.5 * held < rows.count() <= held
        held = rows.count()
    out = cp.run(spark, SF)
    assert out.count() == held and out.where("n_chars <> length(text)").count() == 0
    assert registry.secrets.find_secrets(out).where("size(base) > 0").count() == 0


def test_stages_on_odd_documents(spark, odd_rows, tmp_path, words):
    """Nulls, repeats, ties, clashing names and empty tables through every stage, against plain versions of what each may drop."""
    import corpus_pipeline as cp

    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, secret = say(14), "password = hunter2secret"
    rows = [(i, t, "en" if i is None or i % 2 else "de") for i, t, _ in odd_rows]
    rows += [(None, say(30), "en"), (None, "x " + item + " y", "en"), (None, None, None), (9, secret + " " + say(30), None), (300, say(20) + "\nAKIA" + "Q" * 16, "en"), (300, say(20), "en"), (301, say(20), None)]
    names = ["score", "lang_pred", "lang_set", "lang_shares", "f_id", "f_text", "f_spans", "piece_ids", "r_units", "bad_id", "bad_key", "k_id", "k_text", "best", "led", "chunk", "whole", "set_key", "in_group"]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} double" for n in names)
    own = [0.125] * len(names)
    docs = spark.createDataFrame([(i, t, c, "s", None if t is None else len(t), *own) for i, t, c in rows], shape).repartition(3)
    sf = f"{tmp_path}"
    spark.createDataFrame([(1, item), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    of = lambda df: Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    whole = of(docs)
    letters = lambda t: any(map(str.isalpha, t or ""))
    got = {}
    for name, stage in cp.STAGES:
        out = tk.Scratch(spark, "t").save(stage(spark, docs, sf))
        assert out.columns == docs.columns if name != "pieces" else set(out.columns) == set(docs.columns), name
        assert out.where(" or ".join(f"{n} <> 0.125 or {n} is null" for n in names if n != "piece_ids")).count() == 0, name
        got[name] = of(out)
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    assert set(got["language"]) <= {k for k in whole if letters(k[1])} and all(got["language"][k] in (0, whole[k]) for k in whole)
    assert sum(got["language"].values()) >= 0.8 * sum(n for k, n in whole.items() if letters(k[1]))
    kept, groups = got["near_duplicates"], defaultdict(list)
    sets = [(k, sets_of(k[1])) for k in whole]
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    for i, (k, s) in enumerate(sets):
        groups[find(i)].append((k, s))
    for members in groups.values():
        if not members[0][1]:
            assert all(kept[k] == whole[k] for k, _ in members)  # no words: linked with nothing
        else:
            alive = [k for k, _ in members if kept[k]]
            assert len(alive) == 1 and kept[alive[0]] == 1
            assert (alive[0][0] is None, alive[0][0]) == min(((k[0] is None, k[0]) for k, _ in members), key=lambda x: (x[0], x[1] or 0))
    assert got["decontamination"] == Counter({k: n for k, n in whole.items() if item not in (k[1] or "")})
    changed = Counter({k: n for k, n in whole.items() if k[1] is None or (secret not in k[1] and "AKIA" not in k[1])})
    assert sum(got["secrets"].values()) == sum(whole.values()) and not changed - got["secrets"]
    assert not any(secret in (t or "") or "AKIAQ" in (t or "") for _, t in got["secrets"])
    assert got["pieces"] == whole


def test_pipeline_ids_equal_a_plain_version(spark):
    """The ids that the first four stages keep, by the predicted language, plain sets, plain search and plain spans."""
    import corpus_pipeline as cp
    from tideline.llm import langid, secrets

    docs = tk.table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = langid.predict(docs, langid.fit(docs)).collect()
    rows = {k: t for k, t in rows.items() if k in {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}}
    least = {k: c for k, _, c in brute([(k, t) for k, t in rows.items()])}
    rows = {k: t for k, t in rows.items() if least[k] == k}
    index = decontam.build([r["text"] for r in tk.table(spark, SF, "benchmark").collect()], decontam.SearchRules())
    sieve = np.unpackbits(index.sieve).view(bool)
    clean = {}
    for k, t in rows.items():
        raw = np.frombuffer((t or "").encode(), np.uint8)
        if not any(decontam.search(index, raw, np.array([0, len(raw)]), sieve)):
            clean[k] = t
    out = {r["doc_id"]: r for r in cp.run(spark, SF).collect()}
    assert set(out) == set(clean) and len(out) < docs.count()
    for k, t in clean.items():
        if not secrets.base_spans(t) and "[redacted]" not in out[k]["text"]:
            assert out[k]["text"] == t and out[k]["n_chars"] == len(t)
