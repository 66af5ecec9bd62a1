"""Multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are reported
wherever they match. Weak parts (high-entropy words, account names, endpoints) are gathered
as intervals; a binned interval join within a scope around each weak secret reports the
secret and its partners only when complementary parts co-occur.

Offsets are code points, ends exclusive. Defined cases: a null or empty text has no spans.
Rows that are equal in id and text get equal results. An empty table gives no rows. Columns other
than the id and the text are ignored, whatever their names. Very long texts are scanned whole; the join is by (row, bin) with one
pre-aggregated partner row per role, so its size is linear in the number of parts. The
partners' own spans come from a join of the parts in the same bins, which are as long as a
scope and hold a bounded number of parts. Partners are reported, not redacted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

tk.ship(__name__)

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs are maximal, so shorter runs drop out
_NAME = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|io|internal|local)(?::\d+)?\b", re.A)
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
_HEX_BYTES = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


@dataclass(frozen=True)
class LinkRules:
    """A scope is `reach` code points to each side of a weak secret; `entropy` is bits a character."""

    reach: int = 200
    entropy: float = 3.6


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the strong patterns, in order."""
    raw = text.encode() if raw is None else raw
    out = []
    low = raw.translate(_LOWER)
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def bits(word: str) -> float:
    """Shannon entropy of a word's characters."""
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def weak_parts(text: str, raw: bytes, strong: list[tuple[int, int, int]], rules: LinkRules) -> list[tuple[str, int, int]]:
    """(role, start, end): weak secrets outside strong spans, account names, endpoints, access identifiers."""
    secrets = []
    if raw.translate(_WORD_BYTES).find(b"x" * 16) >= 0:
        for m in _WORD.finditer(text):
            w = m[0]
            mixed = any(map(str.isdigit, w)) and any(map(str.isalpha, w))
            if mixed and bits(w) >= rules.entropy and not any(a < m.end() and m.start() < b for a, _, b in strong):
                secrets.append(("secret", m.start(), m.end()))
    if not secrets:
        return []
    parts = [("name", *m.span(1)) for m in _NAME.finditer(text)]
    parts += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    parts += [("access", a, b) for a, k, b in strong if k == 1]
    return secrets + parts if parts else []


_WORD_BYTES = bytes(120 if chr(c).isalnum() and c < 128 or c in b"+/_=-" else 32 for c in range(256))


def _scanner(rules: LinkRules, id_field: str):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, weak = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                raw = text.encode()
                strong = base_spans(text, raw)
                base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in strong])
                weak.append([{"kind": k, "start": a, "end": b} for k, a, b in weak_parts(text, raw, strong, rules)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(base, span), pa.array(weak, span)], names=[id_field, "text_key", "base", "parts"])

    return run


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, rules: LinkRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, base, linked, partners): strong spans, the weak secrets that co-occurrence adds, and the parts in their scopes, one row a document."""
    rules = rules or LinkRules()
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("text_key")).mapInArrow(
        tk.released(_scanner(rules, id_col)), f"`{id_col}` {kind}, text_key string, base {_SPANS}, parts {_SPANS}"
    )
    scanned = tk.Scratch(docs.sparkSession, "secrets").save(scanned)  # no texts; read three times below
    key = [F.col(id_col).alias("k_id"), F.col("text_key").alias("k_text")]
    parts = scanned.where(F.size("parts") > 0).select(*key, F.explode("parts").alias("p")).select("k_id", "k_text", "p.*").distinct()
    width = 2 * rules.reach
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width)))
    secrets = parts.where("kind = 'secret'").select("k_id", "k_text", "start", "end", bins(F.greatest(F.col("start") - rules.reach, F.lit(0)), F.col("end") + rules.reach).alias("bin"))
    others = parts.where("kind <> 'secret'").select("*", bins(F.col("start"), F.col("end")).alias("bin"))
    p, t = others.alias("p"), secrets.alias("t")
    met = F.col("p.k_id").eqNullSafe(F.col("t.k_id")) & (F.col("p.k_text") == F.col("t.k_text")) & (F.col("p.bin") == F.col("t.bin"))
    met &= (F.col("p.start") < F.col("t.end") + rules.reach) & (F.col("p.end") > F.col("t.start") - rules.reach)
    partners = p.join(t, met, "left_semi").groupBy("k_id", "k_text").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("partners"))
    partners = partners.select(F.col("k_id").alias("p_id"), F.col("k_text").alias("p_text"), "partners")
    # One row a bin and role: a scope is no shorter than a bin, so it holds a bin whole or reaches into it
    # from one side, and the extremes tell whether a part of the bin lies in the scope.
    others = others.groupBy("k_id", "k_text", "bin", "kind").agg(F.min("start").alias("o_start"), F.max("end").alias("o_end"))
    s, o = secrets.alias("s"), others.alias("o")
    near = s.join(o, F.col("s.k_id").eqNullSafe(F.col("o.k_id")) & (F.col("s.k_text") == F.col("o.k_text")) & (F.col("s.bin") == F.col("o.bin"))).where(
        (F.col("o_start") < F.col("s.end") + rules.reach) & (F.col("o_end") > F.col("s.start") - rules.reach)
    )
    linked = (
        near.select("s.k_id", "s.k_text", F.struct(F.lit("linked").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end")).alias("span"))
        .groupBy("k_id", "k_text")
        .agg(F.sort_array(F.collect_set("span")).alias("linked"))
    )
    linked = linked.join(partners, F.col("k_id").eqNullSafe(F.col("p_id")) & (F.col("k_text") == F.col("p_text")), "left")
    return scanned.join(linked, F.col(id_col).eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_text")), "left").select(
        F.col(id_col), "text_key", "base", F.coalesce("linked", F.array().cast(_SPANS)).alias("linked"), F.coalesce("partners", F.array().cast(_SPANS)).alias("partners")
    )


def span_text(spans) -> F.Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, (*KINDS, "linked"))), x["kind"])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank(x).alias("b"), x["end"].alias("c"), x["kind"].alias("d"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["d"], x["a"].cast("string"), x["c"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[redacted]") -> str:
    """Replace each union of overlapping spans by a mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redactor(names: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            spans = batch.column(batch.num_columns - 1).to_pylist()
            done = [t if t is None or not s else redact(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
            cols = [*batch.columns[:text_at], pa.array(done, batch.column(text_at).type), *batch.columns[text_at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def redact_secrets(docs: DataFrame, rules: LinkRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by a mark; all rows and columns stay."""
    rid, rtext, rspans = tk.fresh(docs, "f_id", "f_text", "f_spans")
    found = find_secrets(docs, rules, id_col, text_col).select(F.col(f"`{id_col}`").alias(rid), F.col("text_key").alias(rtext), F.concat("base", "linked").alias(rspans))
    found = found.where(F.size(rspans) > 0).dropDuplicates([rid, rtext])
    key = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    joined = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(rid)) & (key == F.col(rtext)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], rspans)
    return joined.mapInArrow(tk.released(_redactor(docs.columns, docs.columns.index(text_col))), docs.schema)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """SHA-256 of the contract's text for strong spans; used by tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
