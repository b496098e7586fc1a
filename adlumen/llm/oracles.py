"""SQL of the registered queries, where SQL can say it."""

from __future__ import annotations

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

EXACT = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n"""

# Five bits at a time out of the hexadecimal digest.
WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hexed FROM p),
b AS (
  SELECT *, list_transform(generate_series(0, 7), lambda i:
    ('0x' || substr(hexed, CAST(1 + 5 * i AS INT), 5))::BIGINT) AS parts FROM d),
e AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(parts, lambda v:
      substr('{BASE32}', CAST((v >> 15) & 31 AS INT) + 1, 1)
      || substr('{BASE32}', CAST((v >> 10) & 31 AS INT) + 1, 1)
      || substr('{BASE32}', CAST((v >> 5) & 31 AS INT) + 1, 1)
      || substr('{BASE32}', CAST(v & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM b),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

# Windows of ten words as joined strings, looked up by equality.
DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS span,
         array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s
        FROM iw WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM iwin),
dwin AS (
  SELECT doc_id, span, s, array_to_string(w[s : s + span - 1], ' ') AS words
  FROM (SELECT doc_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS s
        FROM dw, spans WHERE len(w) >= span)),
hits AS (SELECT doc_id, item_id, s, span FROM dwin JOIN iwin USING (span, words)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + span - 1)) AS p FROM hits) GROUP BY 1),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""

NEGATIVES = """
WITH r AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label AS label,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE s.label <> s.anchor_label
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10"""

# Every phrase is counted as a joined string.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s
        FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 30),
cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS first,
         array_to_string(ws[cut + 1 : k], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut,
         CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first
              JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
free AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM c d WHERE d.lang = s.lang AND d.phrase <> s.phrase AND 100 * d.a >= 80 * s.a
      AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM free JOIN totals USING (lang)
QUALIFY rank <= 2000"""

ORACLES = {
    "op12_hard_negatives": NEGATIVES,
    "op13_collocations": COLLOCATIONS,
    "op5_exact_dedup": EXACT,
    "op9_warc": WARC,
    "op10_decontamination": DECONTAMINATION,
}
