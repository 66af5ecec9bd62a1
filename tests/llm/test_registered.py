"""Registered queries as a whole against SQL or a plain computation on the smallest tables."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tideline.llm import oracles, pieces, registry
from tideline.llm import textkit as tk

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["op7_licenses", "op9_quality"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.execute(registry.oracle_sql()[name])
    order = sorted(c[0] for c in rel.description)
    at = [[c[0] for c in rel.description].index(c) for c in order]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert Counter(tuple(plain(v) for v in r) for r in registry.queries()[name](spark, SF).select(order).collect()) == want
    assert oracles.OP7


def test_op1_equals_a_plain_computation(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in tk.table(spark, SF, "pages").collect()]
    first = {}
    for i, raw in sorted(pages):
        first.setdefault(raw, i)
    want = {(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[raw] == i else "revisit", None if first[raw] == i else first[raw]) for i, raw in pages}
    got = registry.op1_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(pages)


def test_op2_equals_a_plain_computation(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in tk.table(spark, SF, "documents").collect()]
    from tideline.llm.sharding import SlotMap

    base = SlotMap.fresh(4096, 16)
    grown = base.grown()
    slot = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 4096
    load = Counter()
    for i, raw in docs:
        load[slot(i)] += len(raw) + 1
    even = base.rebalanced(load)
    want = Counter((i, len(raw) + 1, zlib.crc32(raw), "key", base.owner[slot(i)], grown.owner[slot(i)], even.owner[slot(i)]) for i, raw in docs)
    out = registry.op2_sharding(spark, SF).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"], r["rebalanced_shard"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op3_equals_alignment_of_every_pattern(spark):
    import numpy as np

    from tideline.llm import decontam

    texts = {r["doc_id"]: r["text"] for r in tk.table(spark, SF, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in tk.table(spark, SF, "benchmark").collect()]
    index = decontam.build([t for _, t in items], decontam.SearchRules())
    got = {(r["doc_id"], r["item_id"]) for r in registry.op3_decontamination(spark, SF).collect()}
    rows = [(i, t) for i, t in texts.items() if len(t or "") < 6000][::4]  # alignment of every pattern with every text is slow
    want = set()
    for i, t in rows:
        x, _ = decontam.normalise(np.frombuffer((t or "").encode(), np.uint8), np.array([0]))
        for k in range(len(index.of)):
            p = index.rows[k, : index.lengths[k]]
            prev = np.zeros(len(x) + 1, np.int64)  # Sellers' recurrence, a column at a time
            steps = np.arange(len(x) + 1)
            for j, c in enumerate(p, 1):
                cur = np.minimum(np.r_[j, prev[:-1] + (x != c)], prev + 1)
                cur[0] = j
                prev = np.minimum.accumulate(cur - steps) + steps
            if prev.min() <= index.edits[k]:
                want.add((i, items[index.of[k]][0]))
    assert {x for x in got if x[0] in dict(rows)} == want


def test_op10_equals_a_plain_viterbi(spark):
    from test_corpus_operators import MODEL, cut_units, plain_viterbi

    table = pieces.PieceTable.load(MODEL)
    texts = {r["doc_id"]: r["text"] for r in tk.table(spark, SF, "documents").collect()}
    known: dict = {}
    for r in registry.op10_sentencepiece(spark, SF).collect():
        want = []
        for u in cut_units(texts[r["doc_id"]], table) if texts[r["doc_id"]] else []:
            if u not in known:
                known[u] = plain_viterbi(u, table)
            want += known[u]
        assert r["piece_ids"] == want and r["round_trip"] and r["n_pieces"] == len(want)


def test_op4_base_equals_a_plain_computation(spark):
    docs = [(r["doc_id"], r["text"]) for r in tk.table(spark, SF, "documents").collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {i: (held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in docs}
    got = {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in registry.op4_maxent(spark, SF).collect()}
    assert got == want
