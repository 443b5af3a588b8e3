"""DuckDB SQL with the results of those text queries that SQL can express."""

from __future__ import annotations

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("[^\\x20\\x09-\\x0D]+")} AS ws FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN coalesce(len(ws), 0) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s
  FROM w
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 80 * (p.n + q.n - k)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reached r JOIN both_ways l ON l.x = r.y
), named AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN named USING (doc_id)
"""

_ITEM_WORDS = _WORDS.format("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")

OP10 = f"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_ITEM_WORDS}, []) AS ws FROM documents
), iw AS (
  SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM (
    SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p
    FROM (SELECT item_id, ws, least(len(ws), 13) AS k FROM iw WHERE len(ws) > 0)
  )
), sizes AS (SELECT DISTINCT k FROM wins),
grams AS (
  SELECT r, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM (
    SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p
    FROM dw JOIN sizes ON len(ws) >= k
  )
), hits AS (SELECT r, p, grams.k AS k, item_id FROM grams JOIN wins USING (k, g)),
hit_words AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(w.n, 0) > 0 AND 20 * coalesce(w.n, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit_words w USING (r) LEFT JOIN hit_items i USING (r)
"""

OP8 = """
WITH keyed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
      || substr(md5(coalesce(text, '')), 1, 7) AS BIGINT) AS key
  FROM documents
), every AS (
  SELECT key, n_bytes, d, key >> (60 - d) AS prefix FROM keyed, (SELECT unnest(range(0, 61)) AS d)
), fits AS (
  SELECT d, prefix FROM every GROUP BY d, prefix
  HAVING sum(n_bytes) <= 1048576 OR min(key) = max(key)
), depths AS (SELECT key, min(d) AS depth FROM every JOIN fits USING (d, prefix) GROUP BY key),
crowds AS (
  SELECT key, greatest(1, 1048576 // max(n_bytes)) AS page_rows FROM keyed
  GROUP BY key HAVING count(*) > 1 AND sum(n_bytes) > 1048576
)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth,
  CASE WHEN depth = 0 THEN '' ELSE lpad(bin(key >> (60 - depth)), CAST(depth AS INTEGER), '0') END AS shard,
  CAST(CASE WHEN page_rows IS NULL THEN 0
    ELSE (row_number() OVER (PARTITION BY key ORDER BY n_bytes) - 1) // page_rows END AS BIGINT) AS page
FROM keyed JOIN depths USING (key) LEFT JOIN crowds USING (key)
"""

OP12 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM listed GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p
    FROM listed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k
  )
), f AS (SELECT lang, k, g, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30),
parted AS (
  SELECT lang, g, k, n AS a, string_split(g, ' ') AS ws, unnest(range(1, k)) AS c FROM f WHERE k > 1
), scored AS (
  SELECT p.lang, p.g, p.k, p.a, c, x.n AS l, y.n AS r,
    CAST((2000000::HUGEINT * p.a) // (x.n + y.n) AS BIGINT) AS score
  FROM parted p
  JOIN f x ON x.lang = p.lang AND x.g = array_to_string(ws[1:c], ' ')
  JOIN f y ON y.lang = p.lang AND y.g = array_to_string(ws[c + 1:], ' ')
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, c) AS place FROM scored
), held AS (
  SELECT DISTINCT s.lang, s.g FROM f s JOIN f o
    ON o.lang = s.lang AND o.k > s.k AND 100 * o.n >= 80 * s.n
    AND contains(' ' || o.g || ' ', ' ' || s.g || ' ')
  WHERE s.k > 1
), ranked AS (
  SELECT lang, g, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank
  FROM lowest ANTI JOIN held USING (lang, g) WHERE place = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op3_minhash": OP3, "op8_extendible": OP8, "op10_winnowing": OP10, "op12_collocations": OP12}
