"""SQL that checks the queries SQL can express."""

from __future__ import annotations

from quillmill.llm import decontaminate, line_dedup, line_quality, mixing, resample, warc

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, line,
         trim(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g'), ' ') AS k,
         len(regexp_extract_all(line, '{_WORD}')) AS words
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), frequent AS (
  SELECT source, k FROM lines GROUP BY source, k HAVING count(DISTINCT doc_id) > {line_quality.LINE_LIMIT}
), removed AS (
  SELECT doc_id, sum(words) AS n FROM lines l
  JOIN frequent f ON l.k = f.k AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id
), s AS (
  SELECT d.doc_id, len(w) AS n_words, len(regexp_replace(t, '{_SPACE}+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(w) - coalesce(removed.n, 0) AS words_left
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
         AND words_left >= {line_quality.KEPT_SHARE} * n_words AS kept,
       CAST(words_left AS BIGINT) AS words_left
FROM s
"""

OP4 = rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h,
         lower(regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z]+://', '')) AS bare
  FROM pages
), u AS (
  SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS low, octet_length(encode(h)) AS bytes,
         array_to_string(list_reverse(string_split(regexp_extract(bare, '^([^/:?]*)', 1), '.')), ',') AS host,
         regexp_replace(bare, '^[^/?]*', '') AS rest, bare
  FROM p
), r AS (
  SELECT page_id, bytes AS payload_bytes, sha256(h) AS payload_digest,
         CASE WHEN bytes >= {warc.LEAST_BYTES} AND low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN bytes >= {warc.LEAST_BYTES} AND low < page_id THEN low END AS refers_to,
         CASE WHEN bare = '' THEN '' ELSE host || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url_key,
         strftime(make_timestamp((1577836800 + page_id % 2147483648) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM u
)
SELECT *, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS index_place FROM r
"""

_TIME = "CASE WHEN a = b THEN share / a ELSE (sqrt(greatest(a * a + 2.0 * (b - a) * share, 0.0)) - a) / (b - a) END"
OP5 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source
), w AS (
  SELECT *, {list(mixing.WEIGHTS)}[no % 3 + 1] AS weight, {mixing.MOST_REPEATS} * source_size AS most FROM s
), o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER below, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS open_weight,
         row_number() OVER (ORDER BY most / weight, no) AS k
  FROM w WINDOW below AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT CAST(rest AS DOUBLE) / CAST(open_weight AS DOUBLE) AS level FROM o
  WHERE CAST(most AS DOUBLE) >= CAST(rest AS DOUBLE) / CAST(open_weight AS DOUBLE) * weight ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, no, least(level * weight, CAST(most AS DOUBLE)) AS target FROM w, level
), m AS (
  SELECT doc_id, size, source_size, target, no,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, CAST({" + ".join(f"least(greatest(floor(target) - {k} * source_size - before, 0), size)" for k in range(mixing.MOST_REPEATS))} AS BIGINT) AS taken,
         before / floor(target) AS share,
         {[2 * a / (a + b) for a, b in mixing.SCHEDULES]}[no % 3 + 1] AS a,
         {[2 * b / (a + b) for a, b in mixing.SCHEDULES]}[no % 3 + 1] AS b
  FROM m
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, taken,
       CASE WHEN taken > 0 THEN round(abs({_TIME.replace("share", "CAST(share AS DOUBLE)")}), 9) END AS position
FROM x
"""

OP10 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {line_dedup.MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCUMENTS}
), m AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents
), b AS (
  SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS size
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)
), places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b))
), found AS (
  SELECT r, i, p.size, item_id FROM places p JOIN windows v ON p.size = v.size AND p.words = v.words
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""

#: The CRC-32 of a feature's bytes, over the distinct features only.
OP12 = rf"""
WITH steps AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
              ORDER BY b) AS steps FROM range(256) AS r(b)
), texts AS (
  SELECT true AS ours, row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents
  UNION ALL
  SELECT false, row_number() OVER (), NULL, regexp_extract_all({_LOWER}, '{_ALNUM}') FROM benchmark
), features AS (
  SELECT ours, r, unnest(w) AS f FROM texts
  UNION ALL
  SELECT ours, r, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM texts)
  UNION ALL
  SELECT ours, r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM texts)
), bytes AS (
  SELECT f, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)) AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features))
), bucketed AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)
            % {resample.BUCKETS} AS bucket
  FROM bytes, steps
), counts AS (
  SELECT bucket, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t
  FROM features JOIN bucketed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    (CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM counts) + {resample.BUCKETS})
    / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM counts) + {resample.BUCKETS})))) AS BIGINT) AS gain
  FROM counts
), weights AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM features JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE ours GROUP BY r
), scored AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(
           CAST('0x' || substr(sha256('{resample.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
           AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (r) WHERE ours
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {resample.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, r) AS place,
         {resample.SHARE[0]} * count(*) FILTER (n_words >= {resample.LEAST_WORDS}) OVER () // {resample.SHARE[1]} AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= {resample.LEAST_WORDS} AND place <= drawn THEN place END AS rank
FROM placed
"""
