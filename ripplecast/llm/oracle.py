"""DuckDB SQL of this subpackage's queries, for those that SQL can express."""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SEARCH = rf"""
WITH held AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM documents) GROUP BY doc_id, term
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
corpus AS (SELECT count(*) AS all_n, sum(n)::BIGINT AS all_l FROM lengths),
norms AS (SELECT doc_id, 10 + 90 * n * all_n // all_l AS m FROM lengths, corpus),
weights AS (SELECT term, floor(1000 * ln((2 * all_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, corpus GROUP BY term, all_n),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
), placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

#: crc32 byte by byte with the table of its reversed polynomial.
RESAMPLE = rf"""
WITH RECURSIVE crc_steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS by_byte FROM crc_steps WHERE k = 8),
runs AS (
  SELECT 'raw' AS side, doc_id AS id, unnest(regexp_extract_all({LOWER}, '{WORD}')) AS word FROM documents
  UNION ALL
  SELECT 'target', item_id, unnest(regexp_extract_all({LOWER}, '{WORD}')) FROM benchmark
), hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM runs)),
bucketed AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, by_byte[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM hexed, crc_table
), features AS (SELECT side, id, bucket FROM runs JOIN bucketed USING (word)),
totals AS (SELECT bucket, count(*) FILTER (side = 'raw') AS s, count(*) FILTER (side = 'target') AS t FROM features GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM totals, sums),
weighed AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 'raw' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weighed ON doc_id = id
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
