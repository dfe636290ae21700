"""SQL for DuckDB that computes the same rows, for operators that SQL can express.

Left out: personal data (its classifier is trained by expectation-maximisation), language
identification, packing and the alignment of tokenizers. Tests compare these with brute force.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

# Slot k has the point frac(k * 0.618...), with k split at 2**26; blocks have 256 words.
GOLDEN = (5**0.5 - 1) / 2

MIX_SOURCES = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
src AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_id FROM totals),
weighted AS (SELECT *, ([3, 1, 2])[(source_id % 3 + 1)::INT] AS w FROM src),
level(i, lvl) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(w)::DOUBLE FROM weighted
  UNION ALL
  SELECT * FROM (
    SELECT i + 1, (any_value(t.total) - 2::DOUBLE * coalesce(
        sum(source_size) FILTER (2::DOUBLE * source_size < w * lvl), 0)::DOUBLE)
      / sum(w) FILTER (NOT 2::DOUBLE * source_size < w * lvl)::DOUBLE AS nxt
    FROM level, weighted, (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total FROM weighted) t
    GROUP BY i, lvl HAVING nxt > lvl)),
goal AS (
  SELECT *, floor(target)::BIGINT AS whole FROM (
    SELECT source, source_id, source_size,
      least(2::DOUBLE * source_size, w * (SELECT max(lvl) FROM level)) AS target FROM weighted)),
stream AS (
  SELECT row_number() OVER () AS rid, doc_id, size, g.source_id, source_size, target, whole,
    coalesce(sum(size) OVER (PARTITION BY s.source
      ORDER BY md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
need AS (
  SELECT source_id, whole, (whole + 255) // 256 AS slots,
    coalesce(sum(whole) OVER (ORDER BY source_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
  FROM goal),
points AS (
  SELECT k AS slot, (y - floor(y)) * (SELECT sum(whole) FROM need)::DOUBLE AS x
  FROM (SELECT k, (k // 67108864) * {2**26 * GOLDEN % 1.0!r}::DOUBLE
      + (k % 67108864) * {GOLDEN!r}::DOUBLE AS y
    FROM (SELECT unnest(range((SELECT sum(slots)::BIGINT FROM need))) AS k))),
dealt AS (
  SELECT slot, source_id, row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS block
  FROM points JOIN need ON whole > 0 AND x >= low AND x < low + whole),
late AS (
  SELECT source_id, have, unnest(range(have, slots)) AS block
  FROM (SELECT source_id, slots, (SELECT count(*) FROM dealt d WHERE d.source_id = n.source_id) AS have
    FROM need n)),
schedule AS (
  SELECT slot, source_id, block FROM dealt JOIN need USING (source_id) WHERE block < slots
  UNION ALL
  SELECT (SELECT sum(slots)::BIGINT FROM need) + (block - have) * (SELECT count(*) FROM need) + source_id,
    source_id, block FROM late),
passes AS (
  SELECT rid, source_id, epoch * source_size + start AS a,
    least(epoch * source_size + start + size, whole) AS b
  FROM stream, (SELECT unnest([0, 1]) AS epoch)),
pieces AS (
  SELECT rid, source_id, unnest(range(a // 256, (b - 1) // 256 + 1)) AS block FROM passes WHERE a < b),
slotted AS (
  SELECT rid, min(slot)::BIGINT AS first_slot, count(*)::BIGINT AS n_slots
  FROM pieces JOIN schedule USING (source_id, block) GROUP BY rid)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, whole) - start)
   + greatest(0, least(source_size + start + size, whole) - source_size - start))::BIGINT AS taken,
  first_slot, coalesce(n_slots, 0) AS n_slots
FROM stream LEFT JOIN slotted USING (rid)
"""

EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM rows
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b
    ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT rid, rid AS other FROM rows
  UNION
  SELECT r.rid, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (
  SELECT r.rid, min(o.vec_id) AS component_id
  FROM reach r JOIN rows o ON o.rid = r.other GROUP BY r.rid),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id,
  vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN least USING (rid) LEFT JOIN counts ON a = rid
"""

# Base 32 from hexadecimal by way of bits.
WARC_ROUND_TRIP = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
bits AS (
  SELECT hex, array_to_string(list_transform(string_split(hex, ''),
    lambda c: lpad(bin(('0x' || c)::INT)::VARCHAR, 4, '0')), '') AS b
  FROM (SELECT DISTINCT hex FROM hashed)),
digests AS (
  SELECT hex, array_to_string(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT
      + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT
      + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest
  FROM bits),
firsts AS (SELECT hex, min(page_id) AS first FROM hashed GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM hashed JOIN digests USING (hex) JOIN firsts USING (hex)
"""

QUALITY_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
lines AS (
  SELECT rid, source, line, i FROM (
    SELECT rid, source, unnest(string_split(text, chr(10))) AS line,
      unnest(range(len(string_split(text, chr(10))))) AS i FROM docs)
  WHERE regexp_matches(line, '{WORD}')),
dup_lines AS (
  SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines GROUP BY rid),
windows AS (
  SELECT rid, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM docs)),
repeats AS (
  SELECT rid, p FROM windows
  QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) >= 2),
repeat_words AS (
  SELECT rid, count(DISTINCT q)::BIGINT AS n_repeat_words
  FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM repeats) GROUP BY rid),
plain AS (
  SELECT l.rid, l.source, d.text,
    trim(lower(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'))) AS line
  FROM lines l JOIN docs d USING (rid)),
often AS (
  SELECT p.source, line FROM plain p GROUP BY p.source, line HAVING count(DISTINCT text) > 20),
removed AS (
  SELECT rid, sum(len(string_split(p.line, ' ')))::BIGINT AS removed
  FROM plain p JOIN often o ON o.line = p.line AND o.source IS NOT DISTINCT FROM p.source
  GROUP BY rid),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w)::BIGINT - coalesce(removed, 0) AS own_words
  FROM docs LEFT JOIN dup_lines USING (rid) LEFT JOIN repeat_words USING (rid)
    LEFT JOIN removed USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND own_words >= 0.25 * n_words AS kept
FROM counted
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{WORD}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT rid, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
common AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS i
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b
  WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (
  SELECT rid, rid AS other FROM docs
  UNION
  SELECT r.rid, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (
  SELECT r.rid, min(o.doc_id) AS component_id
  FROM reach r JOIN docs o ON o.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs JOIN least USING (rid) LEFT JOIN sizes USING (rid)
"""

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
site AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/')
      THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/')
      THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(url, '[?&]utm_source=(?:feed|rss)(?:[&#]|$)') THEN 'block'
  WHEN regexp_matches(url, '/(?:ads|adserver)/') THEN 'block'
  WHEN regexp_matches(url, '/track(?:ing)?/(?:click|open)/') THEN 'block'
  WHEN regexp_matches(url, '[?&]sessionid=[0-9a-f]+') THEN 'block'
  ELSE 'allow' END AS verdict
FROM site
"""

# The CRC goes over the halves of each byte, lower half first, with the remainders of its polynomial.
IMPORTANCE_RESAMPLING = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, text, true AS is_doc FROM documents
  UNION ALL SELECT row_number() OVER (), NULL, text, false FROM benchmark),
split AS (
  SELECT rid, doc_id, is_doc, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT rid, is_doc, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]))) AS f
  FROM split),
counted AS (SELECT rid, is_doc, f, count(*) AS n FROM runs GROUP BY rid, is_doc, f),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(length(h)),
      lambda i: (strpos('0123456789ABCDEF', substr(h, xor(i, 1) + 1, 1)) - 1)::BIGINT)),
    lambda c, x: xor(c >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960,
      1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896,
      3183342108]::BIGINT[])[xor(c & 15, x) + 1]))) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted))),
buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (is_doc), 0)::DOUBLE AS s,
    coalesce(sum(n) FILTER (NOT is_doc), 0)::DOUBLE AS t
  FROM counted JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT coalesce(sum(s), 0) FROM buckets) + 10000)
    / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM buckets) + 10000))))::BIGINT AS gain
  FROM buckets),
sums AS (
  SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
  FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE is_doc GROUP BY rid),
weighed AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT
      AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM split LEFT JOIN sums USING (rid) WHERE is_doc),
scored AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM weighed),
places AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= 25 * (SELECT count(*) FROM places) // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (rid)
"""

# A control string in a turn costs one character more, a line break in a role five.
CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(length(role) + length(text) + 24
    + len(regexp_extract_all(role || ' ' || text, '<\|\\*(im_start|im_end|nl)\|>'))
    + 5 * (length(role) - length(replace(role, chr(10), ''))))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLE: dict[str, str] = {
    "op1_mix_sources": MIX_SOURCES,
    "op3_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op4_warc_round_trip": WARC_ROUND_TRIP,
    "op7_quality_rules": QUALITY_RULES,
    "op8_jaccard_join": JACCARD_JOIN,
    "op10_url_filter": URL_FILTER,
    "op12_importance_resampling": IMPORTANCE_RESAMPLING,
    "op13_chat_format": CHAT_FORMAT,
}
