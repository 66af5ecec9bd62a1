"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, ScanRules, template_words
from .quality import LineRules

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACES = r"[\x20\x09-\x0D]+"

#: Documents, their shingle sets, exact pairs and components; `docs` is any relation with doc_id and text.
SHINGLES = f"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '{SPACES}'), lambda x: x <> '') AS ws FROM docs),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
"""

OP8 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {SHINGLES}

SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM docs d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


_W = r"[^\x20\x09-\x0D]+"
_NAV = "('|', '»', '›', '•', '·', '>', '/', '::', '-', '–', '←', '→')"
_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in LineRules().boilerplate)

#: Counts and the line rules with their default thresholds.
OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM d),
l AS (SELECT *, regexp_extract_all(line, '{_W}') AS w, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again FROM s WHERE regexp_matches(line, '{_W}')),
f AS (SELECT doc_id, again, len(w) AS n, again
    OR len(list_filter(w, lambda x: x IN {_NAV})) > 0.2 * len(w)
    OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 0.25 * len(w)
    OR {_PHRASES}
    OR (len(w) >= 2 AND length(line) >= 8 AND len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) > 0.6 * len(w))
    OR NOT regexp_matches(CASE WHEN rtrim(w[-1], '"''”’»)]') = '' THEN w[-1] ELSE rtrim(w[-1], '"''”’»)]') END, '[.!?…。！？।؟]$') AS fails FROM l),
a AS (SELECT doc_id, count_if(again)::BIGINT AS n_dup_lines, count(*) AS n_lines, count_if(fails)::BIGINT AS n_failed_lines, coalesce(sum(CASE WHEN fails THEN n END), 0)::BIGINT AS lost_words FROM f GROUP BY doc_id),
o AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_words, 0) AS lost_words
    FROM d LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words <= {LineRules().max_lost} * n_words AS kept FROM o
"""


_SCAN = ScanRules()


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PHRASE_ROWS = ", ".join(f"({_sql_list(p.split())}, '{label}')" for p, label in PHRASES.items())
_TEMPLATE_ROWS = ", ".join(f"('{label}', {_sql_list(template_words(t))}, {-(-_SCAN.percent * len(template_words(t)) // 100)})" for label, t in TEMPLATES)

#: Phrases at every word, and every block with every template.
OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p(phrase, label) AS (VALUES {_PHRASE_ROWS}),
i AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS word FROM d WHERE list_has_any(ws, ['license', 'cc'])),
b AS (SELECT doc_id, word, label FROM i JOIN p ON ws[word + 1:word + len(phrase)] = phrase),
pb AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
t(label, words, need) AS (VALUES {_TEMPLATE_ROWS}),
k AS (SELECT doc_id, list_distinct(ws[a + 1:a + {_SCAN.words(TEMPLATES)}]) AS held FROM (SELECT doc_id, ws, unnest(range(0, len(ws), {_SCAN.step})) AS a FROM d)),
h AS (SELECT doc_id, label, len(list_intersect(held, words)) / len(words) AS share FROM k, t WHERE len(list_intersect(held, words)) >= need),
s AS (SELECT doc_id, max(share) AS share FROM h GROUP BY doc_id),
u AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score FROM d LEFT JOIN pb USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN s USING (doc_id)
"""
