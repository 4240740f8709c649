"""DuckDB SQL for the operators whose result SQL can express."""

from __future__ import annotations

ASCII_WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{ASCII_WORDS}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped,
  sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(capped, 0)) / rest AS level FROM o),
v AS (SELECT arg_min(level, k) AS level FROM l WHERE level <= 2 * source_size / w),
t AS (SELECT source, source_size, CAST(least(2 * source_size, coalesce(level, 1e300) * w) AS DOUBLE) AS target FROM s, v),
f AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal FROM t),
r AS (SELECT d.*, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN goal // f.source_size ELSE 0 END AS full_, CASE WHEN f.source_size > 0 THEN goal % f.source_size ELSE 0 END AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('logloom:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, CAST(size * full_ + least(size, greatest(rest - before, 0)) AS BIGINT) AS taken FROM r"""

_WORDS = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
c AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT c.r, c.n, c.p, g.item FROM c JOIN g USING (n, g)),
k AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN m USING (r)"""

OP5 = """WITH d AS (SELECT row_number() OVER () AS d, doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT d, i, md5(x[i + 1 : i + 200]) AS h FROM (SELECT d, x, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT d, i FROM w SEMI JOIN r USING (h)),
g AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY d ORDER BY i) > 200, true) AS fresh FROM s),
k AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY d ORDER BY i) AS run FROM g),
spans AS (SELECT d, run, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY ALL),
e AS (SELECT d, a, b, coalesce(lag(b) OVER (PARTITION BY d ORDER BY a), 0) AS start FROM (SELECT d, a, b FROM spans UNION ALL SELECT d, n, n FROM d)),
t AS (SELECT d, sum(b - a) AS n_removed, count(*) - 1 AS n_spans, string_agg(hex(x[start + 1 : a]), '' ORDER BY a, b) AS kept FROM e JOIN d USING (d) GROUP BY d)
SELECT doc_id, n AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d JOIN t USING (d)"""

#: 3988292384 is the reversed polynomial of CRC-32.
OP6 = """WITH tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
  list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST(CAST('0x' || x AS INT) AS BIGINT)) AS bytes FROM documents),
k AS (SELECT doc_id, source, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM b, tbl),
c AS (SELECT *, md5('logloom:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32) AS h FROM k),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS f FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY f, source IS NULL, source, h, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 16 // n AS INT) AS shard, p - (p * 16 // n * n + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""

OP7 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to FROM m"""

_KEY = LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

OP9 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, p, lines[p] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS p FROM d)),
k AS (SELECT *, {_KEY} AS key FROM l),
t AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, t.keeper IS NOT NULL AND t.keeper <> k.doc_id AS gone FROM k LEFT JOIN t USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r"""
