"""DuckDB SQL for the results of the queries."""

from terrane.llm.url_reputation import ADDRESS, TWO_LABELS

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         list_sum(list_transform(list_zip(q.vector, x.vector), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.vector) = len(x.vector) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, vec_id, CAST(score AS BIGINT) AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRENGTH = """SELECT 1 / least(0.9, greatest(0.001, CASE WHEN n > 0 AND k > 0 AND k < n AND n - q / n - (g - 1) > 0
    THEN ((r - k * k / n) / (k / n * (1 - k / n)) - (g - 1)) / (n - q / n - (g - 1)) ELSE 0 END)) - 1 AS m, n, k
  FROM (SELECT CAST(count(*) FILTER (n > 0) AS DOUBLE) AS g, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k,
    CAST(sum(n * n) AS DOUBLE) AS q, sum(CASE WHEN n > 0 THEN CAST(k * k AS DOUBLE) / n END) AS r FROM {})"""
URLS = f"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), o AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(CAST(quality = 0 OR toxic = 1 AS BIGINT)) AS k
  FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1
), h AS (
  SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k FROM u LEFT JOIN o USING (page_id) GROUP BY 1
), h1 AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS name FROM h
), h2 AS (
  SELECT *, regexp_matches(name, '{ADDRESS}') AS address, array_to_string(string_split(name, '.')[-2:], '.') AS two,
         array_to_string(string_split(name, '.')[-3:], '.') AS three, string_split(name, '.')[-1] AS one FROM h1
), h3 AS (
  SELECT host, n, k, CASE WHEN address THEN name WHEN regexp_matches(two, '{TWO_LABELS}') THEN two ELSE one END AS suffix,
         CASE WHEN address THEN name WHEN regexp_matches(two, '{TWO_LABELS}') THEN three ELSE two END AS domain FROM h2
), d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h3 GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
ms AS ({_STRENGTH.format("s")}), md AS ({_STRENGTH.format("d")}), mh AS ({_STRENGTH.format("h3")}),
rs AS (SELECT s.suffix, (s.k + m * (ms.k + 0.5) / (ms.n + 1)) / (s.n + m) AS rate FROM s, ms),
rd AS (SELECT d.suffix, d.domain, (d.k + m * rate) / (d.n + m) AS rate FROM d JOIN rs USING (suffix), md),
rh AS (SELECT host, h3.n AS n, m, (h3.k + m * rate) / (h3.n + m) AS rate FROM h3 JOIN rd USING (suffix, domain), mh),
b AS (SELECT host, rate - sqrt(rate * (1 - rate) / (n + m + 1)) > 0.4 AS blocked FROM rh),
f AS (
  SELECT page_id, host, path, blocked,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u JOIN b USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""

SUBSTRINGS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM g
), c AS (
  SELECT DISTINCT doc_id, i + j AS p FROM f, unnest(range(0, 20)) AS t(j) WHERE again
), x AS (
  SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

BYTES = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents
), g AS (
  SELECT doc_id, i, t[i:i + 49] AS k FROM d, unnest(range(1, octet_length(t) - 48)) AS u(i)
), f AS (
  SELECT k, min(doc_id) AS least FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g JOIN f USING (k) WHERE least < doc_id
), s AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), u AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY doc_id, run
), v AS (
  SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 1) AS gap FROM u
), k AS (
  SELECT doc_id, string_agg(hex(t[gap:a - 1]), '' ORDER BY run) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last
  FROM v JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || hex(t[coalesce(last, 1):octet_length(t)]))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

CONTAMINATION = rf"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(8, len(ws)) AS n, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS k
  FROM b, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(ws) - n + 2)) AS t(i)
), h AS (
  SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, k)
), p AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) AS t(j) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') AS k
  FROM w, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (k) WHERE x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r(v, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a
)
SELECT v AS doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id
FROM r LEFT JOIN n ON v = n.doc_id GROUP BY v
"""

ARCHIVES = """
WITH h AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM h
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
