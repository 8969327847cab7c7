"""DuckDB SQL of the queries that it can express."""

from __future__ import annotations

from .repetition import BASE_GRAM, BASE_SHARE, BASE_WORDS, GRAM_LIMITS, LINE_LIMIT, SYMBOL_LIMIT

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def op1(owners: list[int]) -> str:
    """Slots by arithmetic on the digest; the table, which SQL can't fill in turns, as a list."""
    return f"""
WITH t AS (SELECT unnest(generate_series(0, {len(owners) - 1})) AS slot, unnest({owners}) AS shard), d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS UBIGINT) % {len(owners)} AS BIGINT) AS slot FROM documents)
SELECT doc_id, CAST(slot AS INT) AS slot, CAST(shard AS INT) AS shard FROM d JOIN t USING (slot)"""


OP3 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT source, n, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2e0 * n / w, source NULLS LAST) AS k, sum(n) OVER () AS total FROM w),
c AS (SELECT a.k AS k, a.n, a.w, (15e-1 * any_value(a.total) - coalesce(sum(2 * b.n) FILTER (b.k < a.k), 0)) / sum(b.w) FILTER (b.k >= a.k) AS level FROM o a, o b GROUP BY a.k, a.n, a.w),
pick AS (SELECT k, level FROM c WHERE NOT level * w > 2 * n ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.n, CASE WHEN o.k < pick.k THEN CAST(2 * o.n AS DOUBLE) ELSE pick.level * o.w END AS target FROM o, pick),
q AS (SELECT *, CASE WHEN n > 0 THEN least(2, floor(target / n)) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, q.n AS source_size, q.target, q.whole, q.target - q.whole * q.n AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""

_ESC = r"replace(replace(replace({}, '\', '\b'), '#', '\h'), '<', '\l')"
_ROLE = r"replace(replace(replace(" + _ESC.format("role") + r", ':', '\c'), '!', '\x'), chr(10), '\n')"

OP7 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
f AS (SELECT *, CASE WHEN contains(text, '</turn>') OR contains(text, '###') OR regexp_matches(role, '[:!\\n#<\\\\]') THEN '### ' || {_ROLE} || '! ' || {_ESC.format("text")} || ' </turn>' || chr(10) ELSE '### ' || role || ': ' || text || ' </turn>' || chr(10) END AS piece FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def _grams(n: int) -> str:
    """Words inside runs of n words that occur again: id, i."""
    return f"""g{n} AS (SELECT id, i, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM d WHERE len(w) >= {n})),
r{n} AS (SELECT DISTINCT id, unnest(generate_series(i, i + {n - 1})) AS i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS c FROM g{n}) WHERE c > 1),
c{n} AS (SELECT id, count(*) AS words, sum(length(w[i])) AS chars FROM r{n} JOIN d USING (id) GROUP BY id)"""


_LIMITS = " OR ".join(f"dup_{n}gram_chars > {most!r}e0 * greatest(word_chars, 1)" for n, most in GRAM_LIMITS.items())
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT id, i, x[i] AS line FROM (SELECT id, string_split(text, chr(10)) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM d)),
k AS (SELECT id, line, row_number() OVER (PARTITION BY id, line ORDER BY i) AS nth FROM l WHERE regexp_matches(line, '{_WORD}')),
dl AS (SELECT id, count(*) AS n, sum(length(array_to_string(regexp_extract_all(line, '{_WORD}'), ''))) AS chars FROM k WHERE nth > 1 GROUP BY id),
{', '.join(_grams(n) for n in GRAM_LIMITS)},
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, CAST(coalesce(c{BASE_GRAM}.words, 0) AS BIGINT) AS n_repeat_words,
CAST(coalesce(dl.chars, 0) AS BIGINT) AS dup_line_chars, {', '.join(f'CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS dup_{n}gram_chars' for n in GRAM_LIMITS)} FROM d LEFT JOIN dl USING (id) {' '.join(f'LEFT JOIN c{n} USING (id)' for n in GRAM_LIMITS)}),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_SHARE} * n_words AS base_failed, dup_line_chars > {LINE_LIMIT!r}e0 * greatest(word_chars, 1) OR {_LIMITS} AS coverage_failed, n_symbols > {SYMBOL_LIMIT!r}e0 * n_words AS symbol_failed FROM m)
SELECT *, NOT base_failed AND NOT coverage_failed AS kept FROM b"""

_ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10 = f"""
WITH it AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM}') AS w FROM benchmark),
ws AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS g, least(len(w), 13) AS n FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM it WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM}') AS w FROM documents),
p AS (SELECT id, w, unnest(generate_series(1, len(w))) AS pos FROM d WHERE len(w) > 0),
g AS (SELECT id, pos, x.n, array_to_string(w[pos:pos + x.n - 1], ' ') AS g FROM p, (SELECT DISTINCT n FROM ws) x WHERE pos + x.n - 1 <= len(w)),
m AS (SELECT DISTINCT id, pos, g.n, item_id FROM g JOIN ws USING (n, g)),
h AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(generate_series(pos, pos + n - 1)) AS q FROM m) GROUP BY id),
i AS (SELECT id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (id) LEFT JOIN i USING (id)"""
