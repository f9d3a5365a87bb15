"""The contracts of operators 3, 5, 8, 9 and 10 in DuckDB's SQL: all windows and all pairs, for small tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)),
t AS (SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, s, m, item FROM t JOIN p USING (m, k)),
n AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM (SELECT DISTINCT doc_id, s, m FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_REACH = "r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)"

OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS m FROM s l JOIN s r ON l.k = r.k AND l.doc_id < r.doc_id GROUP BY l.doc_id, r.doc_id),
o AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
e AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
{_REACH}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
h AS (SELECT doc_id, s FROM t JOIN (SELECT k, min(doc_id) AS least FROM t GROUP BY k) USING (k) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT x.doc_id, i, word, max(s) OVER (PARTITION BY x.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM x LEFT JOIN h ON h.doc_id = x.doc_id AND h.s = x.i),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS w FROM documents),
c AS (SELECT doc_id, n, o, substr(w, 2 * o + 1, 1122) AS z FROM (SELECT doc_id, w, len(w) // 2 AS n, unnest(range(0, len(w) // 2, 512)) AS o FROM d)),
t AS (SELECT doc_id, o + s AS s, hash(substr(z, 2 * s + 1, 100)) AS k, md5_number(substr(z, 2 * s + 1, 100)) AS k2 FROM (SELECT doc_id, o, z, unnest(range(0, least(512, n - o - 49))) AS s FROM c)),
h AS (SELECT doc_id, s FROM t JOIN (SELECT k, k2, min(doc_id) AS least FROM t GROUP BY k, k2 HAVING min(doc_id) < max(doc_id)) USING (k, k2) WHERE least < doc_id),
x AS (SELECT doc_id, o + i AS i, substr(z, 2 * i + 1, 2) AS byte FROM (SELECT doc_id, o, z, unnest(range(0, least(512, n - o))) AS i FROM c)),
g AS (SELECT x.doc_id, i, byte, max(s) OVER (PARTITION BY x.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM x LEFT JOIN h ON h.doc_id = x.doc_id AND h.s = x.i),
l AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS starts FROM g),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (starts) AS spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN embedding IF y <> 0]) > 0),
e AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v l JOIN v r ON l.vec_id <> r.vec_id AND len(l.x) = len(r.x) WHERE list_cosine_similarity(l.x, r.x) >= 0.95),
{_REACH},
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
