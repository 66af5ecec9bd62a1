"""Line-first quality rules.

Every line is judged by itself (punctuation, navigation, boilerplate, repetition), failing
lines are removed, and a document that loses too large a share of its words is rejected.

Defined cases: a null or blank text has no words, fails the base rule and is not kept, and
its cleaned text is empty. Repeated rows each get their own equal result. Columns other
than the id and the text are ignored, whatever their names. Texts of any length are read
whole; memory is bounded by the longest text of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

tk.ship(__name__)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the rules; every share is of the words of a line or a document."""

    closers: str = ".!?…。！？।؟"
    quotes: str = "\"'”’»)]"
    nav_share: float = 0.2
    symbol_share: float = 0.25
    upper_share: float = 0.6
    upper_min_words: int = 2
    max_lost: float = 0.5
    min_words: int = 10
    max_repeat: float = 0.20
    boilerplate: tuple[str, ...] = (
        "cookie policy", "accept cookies", "accept all cookies", "enable javascript", "terms of use", "terms of service", "privacy policy",
        "all rights reserved", "click here", "sign in to", "sign up for", "log in to", "subscribe now", "subscribe to", "add to cart", "lorem ipsum",
    )


_NAV = frozenset(["|", "»", "›", "•", "·", ">", "/", "::", "-", "–", "←", "→"])


def line_fails(line: str, words: list[str], rules: LineRules, boilerplate: list[str]) -> str:
    """Name of the first rule that a line with words breaks; empty if it breaks none.

    `boilerplate` has those of the phrases that the whole text holds, mostly none.
    """
    n = len(words)
    if sum(map(_NAV.__contains__, words)) > rules.nav_share * n:
        return "navigation"
    if sum(map(line.count, "#*$%&|<>")) > rules.symbol_share * n:
        return "boilerplate"
    if boilerplate and any(map(line.lower().__contains__, boilerplate)):
        return "boilerplate"
    if n >= rules.upper_min_words and len(line) >= 8 and sum(map(str.isupper, words)) > rules.upper_share * n:
        return "boilerplate"
    tail = words[-1].rstrip(rules.quotes) or words[-1]
    if tail[-1] not in rules.closers:
        return "punctuation"
    return ""


SCHEMA = (
    "{id} {type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_failed_lines long, lost_words long, clean_text string"
)


def _kernel(rules: LineRules, id_field: pa.Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            cols: list[list] = [[] for _ in range(11)]
            for p in tk.pieces(texts):
                n_words = np.diff(p.bounds)
                plain = not ((p.data >= 0x1C) & (p.data <= 0x1F)).any()  # then str.split cuts ASCII lines alike
                not_tail = (p.data & 0xC0) != 0x80
                chars, symbols = p.count(p.is_word & not_tail), p.count(_SYMBOL[p.data])
                h, at = p.windows(p.word_hashes(False), 5)
                cut = np.searchsorted(at, p.bounds)
                for i in range(p.n):
                    n, repeated = int(n_words[i]), 0
                    w = h[cut[i] : cut[i + 1]]
                    if len(w) > 1:
                        order = np.argsort(w, kind="stable")
                        same = np.zeros(len(w), bool)
                        s = w[order]
                        eq = s[1:] == s[:-1]
                        same[order[1:][eq]] = True
                        same[order[:-1][eq]] = True
                        if eq.any():
                            edge = np.zeros(len(w) + 5, np.int32)
                            edge[: len(w)] += same
                            edge[5 : len(w) + 5] -= same
                            repeated = int((np.cumsum(edge) > 0).sum())
                    dup = failed = lost = lines = 0
                    seen: set[str] = set()
                    kept_lines = []
                    text = texts[p.first + i].as_py() or ""
                    phrases = list(filter(text.lower().__contains__, rules.boilerplate))
                    for line in text.split("\n"):
                        words = line.split() if plain and line.isascii() else _WORDS(line)
                        if not words:
                            continue
                        lines += 1
                        again = line in seen
                        dup += again
                        seen.add(line)
                        if again or line_fails(line, words, rules, phrases):
                            failed += 1
                            lost += len(words)
                        else:
                            kept_lines.append(line)
                    bad = n < rules.min_words or repeated > rules.max_repeat * n
                    row = (n, int(chars[i]), int(symbols[i]), dup, repeated, bad, not bad and lost <= rules.max_lost * n, lines, failed, lost, "\n".join(kept_lines))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_words", "clean_text"]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_field, *names])

    return run


_WORDS = re.compile("[^\x20\x09-\x0d]+").findall


def clean_lines(docs: DataFrame, rules: LineRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, verdict and cleaned text of every document; see the module docstring for odd input."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_kernel(rules or LineRules(), id_col), SCHEMA.format(id=f"`{id_col}`", type=kind))
