"""SQL (DuckDB) for the queries whose results SQL can express."""

from __future__ import annotations

from vistaframe.llm.url_filter import BLOCKED_HOSTS, CATEGORIES, RULES

ORACLES: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_entries = ", ".join([f"('{p}', '{v}', TRUE)" for p, v in RULES] + [f"('{h}/', 'block', FALSE)" for h in BLOCKED_HOSTS])
_rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_named = "(^|[^a-z])(" + "|".join(sorted({w for of in CATEGORIES.values() for w in of})) + ")([^a-z]|$)"

ORACLES["op1_url_filters"] = f"""
WITH p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce({_rest}, '') AS rest FROM pages)),
l AS (SELECT string_split(host, '.') AS parts FROM p),
h AS (SELECT DISTINCT array_to_string(list_slice(parts, place, len(parts)), '.') AS host FROM (SELECT parts, list_max(list_filter(range(1, len(parts) + 1), lambda i: regexp_matches(parts[i], '{_named}'))) AS place FROM l) WHERE place IS NOT NULL),
e(prefix, verdict, is_rule) AS (SELECT * FROM (VALUES {_entries}) UNION SELECT host || '/', 'block', FALSE FROM h),
m AS (SELECT page_id, prefix, verdict, is_rule, row_number() OVER (PARTITION BY page_id ORDER BY is_rule DESC, length(prefix) DESC) AS place
      FROM p JOIN e ON (host = split_part(prefix, '/', 1) OR ends_with(host, '.' || split_part(prefix, '/', 1)))
                   AND starts_with(CASE WHEN path = '' AND NOT is_rule THEN '/' ELSE path END, substr(prefix, instr(prefix, '/'))))
SELECT p.page_id, host, path, CASE WHEN is_rule THEN prefix END AS rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE place = 1) m ON p.page_id = m.page_id
"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op2_benchmark_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, list_slice(w, i, i + 12) AS gram FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
n AS (SELECT DISTINCT len(gram) AS n FROM g),
o AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT rid, i, n, item FROM o JOIN g ON o.gram = g.gram),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN i ON d.rid = i.rid
"""

_bits = "array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha, 1 + 5 * k, 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS INTEGER), 1)), '')), '')"

ORACLES["op5_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_bits} AS payload_digest,
       CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM q
"""

_SPACED = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES["op6_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""

ORACLES["op10_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_SPACED.format("text")} AS w FROM documents),
o AS (SELECT doc_id, rid, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS gram FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT gram, min(doc_id) AS first FROM o GROUP BY gram),
h AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS pos FROM o JOIN f ON o.gram = f.gram AND o.doc_id > f.first),
c AS (SELECT rid, list(pos) AS gone, count(*) AS n FROM h GROUP BY rid),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS kept FROM (SELECT d.rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d JOIN c ON c.rid = d.rid) z WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.rid = z.rid AND h.pos = z.pos) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(CASE WHEN c.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN c ON c.rid = d.rid LEFT JOIN k ON k.rid = d.rid
"""

_key = _LOWER.format("trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")

ORACLES["op11_line_dedup"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, i, line, {_key} AS key FROM (SELECT rid, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d)),
c AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
k AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM l WHERE key NOT IN (SELECT key FROM c) GROUP BY rid)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, len(lines) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid
"""

ORACLES["op13_lexical_search"] = f"""
WITH b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)),
a AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(words) AS term FROM b) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT count(*) AS docs, sum(len(words)) AS terms FROM d WHERE len(words) > 0),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, docs),
m AS (SELECT rid, doc_id, 25 + CAST((75 * len(words) * docs) // terms AS BIGINT) AS m FROM d, s WHERE len(words) > 0),
x AS (SELECT q, m.rid, any_value(doc_id) AS doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM a JOIN f ON a.term = f.term JOIN t ON t.term = a.term JOIN m ON m.rid = t.rid GROUP BY q, m.rid),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b ON b.q = k.q WHERE rank <= 10
"""
