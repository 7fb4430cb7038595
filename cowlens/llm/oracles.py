"""DuckDB SQL of the corpus queries that SQL can express, over whole tables. It says what is to come out, not how."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _windows(width: int) -> str:
    """t(r, word, i): words by place; k(r, i, key, n, many): windows that begin there, with their words and those of the text."""
    return f"""
t AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT r, i, string_agg(word, ' ') OVER f AS key, count(*) OVER f AS n, count(*) OVER (PARTITION BY r) AS many FROM t
      WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING))"""


_REACH = """
reach(r, m) AS (SELECT r, r FROM d UNION SELECT links.y, reach.m FROM reach JOIN links ON reach.r = links.x),
root AS (SELECT reach.r, min(o.id) AS id FROM reach JOIN d o ON o.r = reach.m GROUP BY reach.r)"""

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
{_windows(35)},
twice AS (SELECT key FROM k WHERE n = 35 GROUP BY key HAVING count(*) > 1),
hit AS (SELECT r, i, 1 AS h FROM k WHERE n = 35 AND key IN (SELECT key FROM twice)),
mark AS (SELECT t.r, t.i, t.word, max(coalesce(hit.h, 0)) OVER (PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
         FROM t LEFT JOIN hit ON t.r = hit.r AND t.i = hit.i),
kept AS (SELECT r, count(*) AS n, sum(gone) AS away, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS rest FROM mark GROUP BY r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(away, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id AS id, regexp_extract_all(coalesce(translate(text, '{_UPPER}', '{_LOWER}'), ''), '{_WORD}') AS w FROM documents),
{_windows(5)},
s AS (SELECT DISTINCT r, key FROM k WHERE n = 5 OR (many < 5 AND i = 1)),
c AS (SELECT r, count(*) AS n FROM s GROUP BY r),
met AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM s a JOIN s b ON a.key = b.key AND a.r <> b.r GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN c p ON p.r = x JOIN c q ON q.r = y WHERE 100 * met.n >= 80 * (p.n + q.n - met.n)),
{_REACH}
SELECT d.id AS doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(root.id, d.id) AS component_id
FROM d LEFT JOIN c USING (r) LEFT JOIN root USING (r)
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT r, label, list_transform(e, lambda x: coalesce(x, 0)) AS e FROM d WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_max(list_transform(e, lambda x: abs(x))) > 0),
pairs AS (SELECT a.r AS x, b.r AS y, a.e AS p, b.e AS q FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)),
links AS (SELECT x, y FROM pairs WHERE list_cosine_similarity(p, q) >= 0.98),
many AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x),
{_REACH}
SELECT d.id AS vec_id, coalesce(many.n, 0)::BIGINT AS n_links, root.id AS component_id, coalesce(d.id = root.id, false) AS kept
FROM d LEFT JOIN many USING (r) LEFT JOIN root USING (r)
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
{_windows(3)},
twice AS (SELECT r, key FROM k WHERE n = 3 GROUP BY r, key HAVING count(*) > 1),
hit AS (SELECT k.r, k.i, 1 AS h FROM k JOIN twice ON k.r = twice.r AND k.key = twice.key WHERE k.n = 3),
mark AS (SELECT t.r, max(coalesce(hit.h, 0)) OVER (PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again
         FROM t LEFT JOIN hit ON t.r = hit.r AND t.i = hit.i),
again AS (SELECT r, sum(again) AS n FROM mark GROUP BY r),
lines AS (SELECT r, unnest(string_split(x, chr(10))) AS line FROM d),
own AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM lines WHERE length(translate(line, {_SPACES}, '')) > 0 GROUP BY r),
flat AS (SELECT r, host, unnest(string_split(translate(lower(x), '123456789' || chr(9) || chr(11) || chr(12) || chr(13), '000000000    '), chr(10))) AS line FROM d),
normal AS (SELECT r, host, trim(line) AS line, len(regexp_extract_all(line, '{_WORD}')) AS words FROM flat WHERE trim(line) <> ''),
common AS (SELECT host, line FROM normal GROUP BY host, line HAVING count(DISTINCT r) > 20),
gone AS (SELECT normal.r, sum(words) AS n FROM normal JOIN common ON normal.host = common.host AND normal.line = common.line GROUP BY normal.r),
base AS (
    SELECT d.r, d.doc_id, len(w)::BIGINT AS n_words, length(translate(x, {_SPACES}, ''))::BIGINT AS word_chars,
        (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(own.dup, 0)::BIGINT AS n_dup_lines,
        coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_line_words_removed
    FROM d LEFT JOIN own USING (r) LEFT JOIN again USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_line_words_removed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_line_words_removed <= 50 * n_words AS kept
FROM base
"""

#: The others train models, follow a tokeniser, pack bins, or take copies by a hash that SQL does not have.
ORACLES = {"op2_substring_dedup": OP2, "op3_jaccard_join": OP3, "op7_vector_dedup": OP7, "op8_quality_rules": OP8}
