"""Licence scan: exact phrases, and an exact set-similarity join of text blocks with templates.

DataFrame functions only. The words of a template are ordered by how many documents hold
them, rarest first. A block contains a template when it holds at least `percent` of its
distinct words. A qualifying pair must share a word of the template's prefix (the rarest
|T| - o + 1 words, o the words needed), so blocks are equi-joined with prefixes only; the
length filter and the positional filter discard pairs that can no longer reach o, and the
overlap of the rest is counted in full. Words that are in no template can't count and are
left out of blocks before ordering.

Blocks start every `step` words and have room for the longest template, a quarter more, and a step,
so a template with up to a quarter of other words between its own lies whole in one.

Defined cases: a null or blank text has no words, no places and no labels, and scores 0.
Rows equal in id and text get equal results. An empty table gives no rows. Columns other than the id
and the text are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Texts of licences, and notices that licences themselves prescribe, with their labels.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


@dataclass(frozen=True)
class ScanRules:
    """Blocks have room for the longest template, a quarter more, and a step, or at least `block` words."""

    percent: int = 90
    block: int = 96
    step: int = 48

    def words(self, templates: list[tuple[str, str]]) -> int:
        longest = max((len(all_words(t)) for _, t in templates), default=0)
        return max(self.block, longest * 5 // 4 + self.step)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at ASCII characters other than letters and digits."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def all_words(text: str) -> list[str]:
    """The same for a template."""
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    return list(dict.fromkeys(all_words(text)))


def _list(values) -> Column:
    return F.array(*map(F.lit, values))


def _places(phrase: str) -> Column:
    """Word places at which a phrase starts; looked for only where its last word occurs."""
    parts = phrase.split()
    n = len(parts)
    whole = F.filter(F.sequence(F.lit(0), F.size("words") - n), lambda i: (F.get("words", i) == parts[0]) & (F.slice("words", i + 1, n) == _list(parts)))
    return F.when((F.size("words") >= n) & F.array_contains("words", parts[0]) & F.array_contains("words", parts[-1]), whole).otherwise(F.array().cast("array<int>"))


def _tag(label: str):
    return lambda place: F.struct(F.lit(label).alias("label"), place.cast("long").alias("word"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, rules: ScanRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places, base_labels, block_labels, best) of every document.

    `places` has (label, word) of each phrase; `best` is the largest share of a template that
    qualifies, 1 where a phrase stands, else 0.
    """
    rules, templates = rules or ScanRules(), TEMPLATES if templates is None else templates
    kinds = [(label, template_words(text)) for label, text in templates]
    kinds = [(label, t) for label, t in kinds if t]
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col), F.length(text_col)).alias("_key"), words(F.col(text_col)).alias("words"))
    phrases = list(PHRASES.items())
    base = rows.select("_id", "_key", F.size("words").cast("long").alias("n_words"), *[_places(p).alias(f"_p{i}") for i, (p, _) in enumerate(phrases)])
    tagged = [F.transform(f"_p{i}", _tag(label)) for i, (_, label) in enumerate(phrases)]
    base = base.select("_id", "_key", "n_words", F.concat(*tagged).alias("places"))
    found = _join_blocks(rows, kinds, rules, rules.words(templates))
    out = base.join(found, base["_id"].eqNullSafe(found["f_id"]) & (base["_key"] == found["f_key"]), "left")
    share = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "places", F.array_sort(F.array_distinct(F.col("places")["label"])).alias("base_labels"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("block_labels"), share.alias("best"),
    )


def _join_blocks(rows: DataFrame, kinds: list[tuple[str, list[str]]], rules: ScanRules, block: int) -> DataFrame:
    """(f_id, f_key, labels, share) of documents with a block that contains a template."""
    spark = rows.sparkSession
    vocabulary = sorted({w for _, t in kinds for w in t})
    shape = "f_id string, f_key long, labels array<string>, share double"
    if not vocabulary:
        return spark.createDataFrame([], shape)
    counts = rows.select(F.explode(F.array_intersect("words", _list(vocabulary))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    seen = {r["w"]: r["n"] for r in counts.collect()}  # at most the templates' own words
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    prefix, starts = [], set()
    for label, t in kinds:
        ranks = sorted(rank[w] for w in t)
        need = -(-rules.percent * len(t) // 100)
        for i in range(len(t) - need + 1):
            prefix.append((ranks[i], label, i, len(t), need, ranks))
            starts.add(order[ranks[i] - 1])
    index = F.broadcast(spark.createDataFrame(prefix, "rank long, label string, i int, size int, need int, template array<long>"))
    likely = rows.where(F.arrays_overlap("words", _list(sorted(starts))))
    blocks = likely.select("_id", "_key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(rules.step))).alias("from"))
    held = F.array_intersect(F.slice("words", F.col("from") + 1, block), _list(order))
    least = min(p[4] for p in prefix)
    blocks = blocks.select("_id", "_key", "from", held.alias("held")).where(F.size("held") >= least)  # length filter
    blocks = blocks.select("_id", "_key", "from", F.array_sort(F.transform("held", lambda w: F.array_position(_list(order), w))).alias("ranks"))
    probes = blocks.select("_id", "_key", "from", "ranks", F.posexplode("ranks").alias("j", "rank"))
    near = (F.least(F.col("size") - F.col("i"), F.size("ranks") - F.col("j")) >= F.col("need")) & (F.size("ranks") >= F.col("need"))  # positional, length
    pairs = probes.join(index, "rank").where(near)
    overlap = F.size(F.array_intersect("ranks", "template"))
    hits = pairs.select("_id", "_key", "label", (overlap / F.col("size")).alias("share"), (overlap >= F.col("need")).alias("ok")).where("ok")
    return hits.groupBy(F.col("_id").alias("f_id"), F.col("_key").alias("f_key")).agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max("share").alias("share"))
