"""Language, secrets, licences, quality: odd input against plain versions."""

import gc
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import langid, licenses, ngramjoin, pieces, quality, registry, secrets
from tideline.llm import textkit as tk

SF = "/root/testdata/sf0.001"


def by_row(df):
    return Counter(tuple(r) for r in df.collect())


def test_kernels_cut_words_like_bytes_split(odd_rows):
    import pyarrow as pa

    texts = [t for _, t, _ in odd_rows]
    at = 0
    for p in tk.pieces(pa.array(texts, pa.string()), 1000):
        for i in range(p.n):
            raw = (texts[at] or "").encode()
            got = [bytes(p.data[p.starts[j] : p.ends[j]]) for j in range(p.bounds[i], p.bounds[i + 1])]
            assert got == raw.split()
            at += 1
    assert at == len(texts)


def plain_quality(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_counts(spark, odd, odd_rows, empty):
    out = quality.clean_lines(odd)
    got = by_row(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == Counter((i, *plain_quality(t)) for i, t, _ in odd_rows)
    assert out.where("base_failed and kept").count() == 0
    assert quality.clean_lines(empty).count() == 0
    repeated = spark.createDataFrame([(1, "a b c d e f a b c d e g " + "a b c d e " * 3), (2, "a a a a a a a")], "doc_id int, text string")
    assert by_row(quality.clean_lines(repeated).select("doc_id", "n_repeat_words")) == Counter({(1, 25): 1, (2, 7): 1})


def test_quality_rules_drop_lines_and_documents(spark, words):
    good = "\n".join(" ".join(words[8 * i : 8 * i + 8]).capitalize() + "." for i in range(6))
    rows = [(1, good), (2, good + "\n | home | about | help |"), (3, "\n".join(["| home | about |", "SHOUTING LINES EVERYWHERE HERE!!", "no end of line at all"] * 4 + ["A fine line with words."]))]
    got = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == good
    assert got[2]["kept"] and got[2]["clean_text"] == good and got[2]["n_failed_lines"] == 1
    assert not got[3]["kept"]


def plain_spans(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


SECRETS = [
    (1, "é token = \"abcdef123\" AKIA" + "B" * 16 + " " + "ab12" * 8), (2, "PassWord: 'short' api_key=longenough1"), (3, None), (4, "ſecret=abcdefgh toKen=abcdefgh"),
    (5, "token=" + "ab12" * 10), (6, "AKIAAKIA" + "C" * 12 + " secret: x secret: yyyyyy"), (6, "AKIAAKIA" + "C" * 12 + " secret: x secret: yyyyyy"), (None, "passwd=abcdefghij"),
]


def test_secrets_base_spans(spark, odd, odd_rows):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(SECRETS, "doc_id long, text string"))
    got = by_row(secrets.find_secrets(docs).select("doc_id", F.sha2(secrets.span_text(F.col("base")), 256)))
    want = Counter((i, hashlib.sha256(plain_spans(t).encode()).hexdigest()) for i, t in [*((i, t) for i, t, _ in odd_rows), *SECRETS])
    assert got == want


def test_weak_secrets_need_a_partner_in_their_scope(spark, empty):
    weak = "Zk3vQ9xLm2Tr8Wp5Yc7D"
    rows = [
        (1, f"nothing but {weak} here"), (2, f"user: alice and {weak} here"), (3, f"{weak} goes to https://db.example.com/x"), (4, f"user: alice {'word ' * 100} {weak}"),
        (5, f"{'word ' * 300} login=bob12 {weak} {'word ' * 300} {weak}"), (6, f"AKIA{'A' * 16} {weak}"),
    ]
    out = {r["doc_id"]: [(s["start"], s["end"]) for s in r["linked"]] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    first = lambda i: [(rows[i - 1][1].index(weak), rows[i - 1][1].index(weak) + len(weak))]
    assert out == {1: [], 2: first(2), 3: first(3), 4: [], 5: first(5), 6: first(6)}
    assert secrets.find_secrets(empty).count() == 0


def test_interval_join_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    weak = ["Zk3vQ9xLm2Tr8Wp5Yc%02d" % i for i in range(100)]
    docs = []
    for d in range(30):
        parts = ["word " * int(rng.integers(0, 90)) + str(rng.choice(["user=alice", "https://a.example.com", weak[i % 100]])) for i in range(25)]
        docs.append((d, " ".join(parts)))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["linked"]] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    rules = secrets.LinkRules()
    for d, t in docs:
        parts = secrets.weak_parts(t, t.encode(), secrets.base_spans(t), rules)
        others = [p for p in parts if p[0] != "secret"]
        assert got[d] == sorted((a, b) for k, a, b in parts if k == "secret" and any(o[1] < b + rules.reach and o[2] > a - rules.reach for o in others))


def test_partners_of_weak_secrets_are_reported(spark):
    rng = np.random.default_rng(7)
    weak = "Zk3vQ9xLm2Tr8Wp5Yc7D"
    kinds = ["user=alice", "https://a.example.com", "AKIA" + "A" * 16, weak, "https://b.example.com/" + "p" * 900]
    docs = [(d, " ".join("word " * int(rng.integers(0, 90)) + str(rng.choice(kinds)) for _ in range(20))) for d in range(20)] + [(None, f"user=bob12 {weak}")]
    rules, want = secrets.LinkRules(), {}
    for d, t in docs:
        parts = secrets.weak_parts(t, t.encode(), secrets.base_spans(t), rules)
        weaks = [p for p in parts if p[0] == "secret"]
        want[d] = sorted({p for p in parts if p[0] != "secret" and any(p[1] < b + rules.reach and p[2] > a - rules.reach for _, a, b in weaks)})
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    assert {r["doc_id"]: [tuple(x) for x in r["partners"]] for r in secrets.find_secrets(frame.unionAll(frame)).collect()} == want
    assert len({k for p in want.values() for k, _, _ in p}) == 3 and want[None]


def test_redaction_keeps_rows_and_columns(spark, odd):
    docs = spark.createDataFrame([(1, "x token=abcdefgh y", "en"), (1, "x token=abcdefgh y", "en"), (2, None, None), (3, "clean", "fr")], "doc_id long, text string, lang string")
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns
    assert by_row(out) == Counter({(1, "x [redacted] y", "en"): 2, (2, None, None): 1, (3, "clean", "fr"): 1})
    assert secrets.redact("abcdef", [(1, 3), (2, 5)]) == "a[redacted]f"


def plain_places(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return len(w), sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_licence_places(spark, odd, odd_rows, empty):
    more = [(1, "cc by cc by"), (2, "GNU-General\nPublic  License"), (3, "mit licenseé"), (4, "the MIT License the apache license")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_words"], tuple(sorted((p["word"], p["label"]) for p in r["places"]))) for r in licenses.scan(docs).collect())
    assert got == Counter((i, n, tuple(p)) for i, t in [*((i, t) for i, t, _ in odd_rows), *more] for n, p in [plain_places(t)])
    assert licenses.scan(empty).count() == 0


def test_licence_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    templates = [("a", "permission is granted to use copy and modify this thing"), ("b", "no warranty of any kind is given for this thing"), ("c", "keep this notice")]
    pool = sorted({w for _, t in templates for w in t.split()}) + [f"w{i}" for i in range(30)]
    docs = []
    for i in range(60):
        w = list(rng.choice(pool, 150))
        for _, t in templates:
            if rng.random() < 0.4:
                at, words = int(rng.integers(0, 100)), [x for x in t.split() if rng.random() < 0.95]
                w[at : at + len(words)] = words
        docs.append((i, " ".join(w)))
    rules = licenses.ScanRules(percent=80, block=24, step=12)
    got = {r["doc_id"]: r["block_labels"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id int, text string"), templates, rules).collect()}
    for i, t in docs:
        w, found = t.split(), set()
        for a in range(0, len(w), rules.step):
            block = set(w[a : a + rules.words(templates)])
            found |= {label for label, x in templates if len(block & set(x.split())) >= -(-80 * len(set(x.split())) // 100)}
        assert got[i] == sorted(found)
    assert any(got.values()) and not all(got.values())


def test_whole_licence_texts_are_found_wherever_they_stand(spark):
    rows = []
    for n, (label, text) in enumerate(licenses.TEMPLATES):
        for before in (0, 17, 48, 101):
            noisy = " rem ".join(" ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
            rows += [(n, label, "word " * before + text + " more" * 60), (n, label, "word " * before + noisy)]
    docs = spark.createDataFrame([(i, label, t) for i, (_, label, t) in enumerate(rows)], "doc_id int, label string, text string")
    got = {r["doc_id"]: r["block_labels"] for r in licenses.scan(docs).collect()}
    assert all(label in got[i] for i, (_, label, _) in enumerate(rows))


def test_language_odd_input(spark, odd, empty):
    model = langid.fit(odd)
    assert model.languages == ["de", "en", "fr"]
    out = langid.predict(odd, model)
    assert out.count() == odd.count()
    und = {r["doc_id"] for r in out.where("lang_pred = 'und'").collect()}
    assert und == {0, 1, 2}
    assert out.where("score < 0 or score > 1 or (lang_pred = 'und') <> (score = 0)").count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_language_held_out_accuracy_and_mixtures(spark):
    docs = tk.table(spark, SF, "documents")
    out = registry.op5_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count()
    model = langid.fit(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) > 3000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    a, b = sorted(texts)[:2]
    mixed = spark.createDataFrame([(1, texts[a][:2000] + "\n" + texts[b][:1000])], "doc_id int, text string")
    r = langid.predict(mixed, model).first()
    assert set(r["lang_set"]) == {a, b} and r["lang_pred"] == a and 0.5 < r["score"] < 0.8


def test_em_proportions_of_a_known_mixture():
    rng = np.random.default_rng(2)
    like = rng.dirichlet(np.ones(50) * 0.2, 3).T
    counts = rng.multinomial(20000, like @ np.array([0.6, 0.3, 0.1]))
    pi, ll, gap = langid.em(like, counts.astype(float), 300, close=1e-3)
    assert np.allclose(pi, [0.6, 0.3, 0.1], atol=0.02)
    assert ll >= counts @ np.log(like @ np.array([0.6, 0.3, 0.1])) - 1e-3
    for rounds in (0, 1, 3, 300):  # the bound holds wherever EM stops
        _, early, above = langid.em(like, counts.astype(float), rounds)
        assert early <= ll + 1e-6 and early + above >= ll - 1e-6
    assert gap <= 1e-3


@pytest.mark.parametrize("name", ["op6_secrets", "op7_licenses", "op9_quality"])
def test_queries_return_every_document(spark, name):
    docs = tk.table(spark, SF, "documents")
    out = registry.queries()[name](spark, SF)
    assert out.count() == docs.count() and out.select("doc_id").distinct().count() == docs.count()


def test_memory_is_given_back_when_a_task_holds_nothing_more(monkeypatch):
    """At the end of a task its units, lookups and pieces are gone before freed memory goes back."""
    table = pieces.PieceTable([("a", 0, -1.0), (" a", 1, -0.5), ("ab", 2, -0.7)], 3, ["a", " a", "ab", *range(256)])
    shared = lambda x: type("Shared", (), {"value": x})()
    held = []
    monkeypatch.setattr(tk, "release", lambda: held.append([o for o in gc.get_objects() if type(o) in (pieces.Units, pieces.Lookup, tk.Piece)]))
    batch = pa.RecordBatch.from_arrays([pa.array([" ab a b", " aab"]), pa.array([1, 1], pa.int64())], names=["led", "chunk"])
    for f in (tk.released(pieces._counter(shared(pieces.joins(table)))), tk.released(ngramjoin._cutter(5, 4))):
        out = list(f(iter([batch])))
        assert out and held.pop() == []
        del out


def test_tables_of_the_driver_need_no_python_workers(spark):
    """Rows that are pickled are unpickled by Python workers on the executors, of another kind than the operators'."""
    rows = [(i, None if i == 3 else f"é{i}", i / 4) for i in range(5)]
    made = tk.local(spark, rows, "n long, word string, x double")
    assert made.schema.simpleString() == "struct<n:bigint,word:string,x:double>"
    assert [tuple(r) for r in made.collect()] == rows
    assert "Python" not in made._jdf.queryExecution().toRdd().toDebugString()
    assert tk.local(spark, [], "n long, word string").collect() == []
    assert tk.local(spark, [([1],)], "n array<int>").collect()[0]["n"] == [1]
