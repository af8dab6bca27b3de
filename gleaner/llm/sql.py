"""DuckDB SQL for the registered queries that SQL can express."""

URL_FILTERS = r"""
WITH pg AS (
  SELECT page_id, url,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', '') AS h,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path,
         md5(concat_ws('|', page_id::VARCHAR, url)) AS m
  FROM pages),
cap AS (
  SELECT page_id, url, CASE WHEN h <> '' THEN h END AS host, path,
         (DATE '2024-01-01' + ('0x' || substr(m, 1, 2))::INT) AS fetched_on
  FROM pg),
pat AS (
  SELECT DISTINCT 'domains' AS list, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS pattern, 1 AS digit, 90 AS most
  FROM cap WHERE host IS NOT NULL
  UNION ALL SELECT DISTINCT 'hosts', host, 3, 60 FROM cap WHERE host IS NOT NULL
  UNION ALL SELECT DISTINCT 'paths', host || '/' || regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1), 5, 60
  FROM cap WHERE host IS NOT NULL AND regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1) <> ''),
listed AS (SELECT list, pattern, md5(pattern) AS m FROM pat WHERE ('0x' || substr(md5(pattern), digit, 2))::INT < most),
d AS (
  SELECT list, pattern, ('0x' || substr(m, 7, 2))::INT AS a, ('0x' || substr(m, 9, 2))::INT AS b, ('0x' || substr(m, 11, 2))::INT AS c
  FROM listed),
lg AS (
  SELECT list, pattern, 0 AS seq, 'add' AS action, DATE '2024-01-01' + a AS day FROM d
  UNION ALL SELECT list, pattern, 1, 'remove', DATE '2024-01-01' + a + b FROM d
  UNION ALL SELECT list, pattern, 2, 'add', DATE '2024-01-01' + a + b + c FROM d),
daily AS (SELECT list, pattern, day, arg_max(action, seq) AS action FROM lg GROUP BY ALL),
iv AS (
  SELECT list, pattern, day AS valid_from, action,
         coalesce(lead(day) OVER (PARTITION BY list, pattern ORDER BY day), DATE '9999-12-31') AS valid_to
  FROM daily),
hit AS (
  SELECT cap.page_id, cap.url, iv.list, iv.valid_from
  FROM cap JOIN iv ON iv.action = 'add' AND cap.fetched_on >= iv.valid_from AND cap.fetched_on < iv.valid_to
   AND (cap.host = iv.pattern OR ends_with(cap.host, '.' || iv.pattern)
        OR starts_with(cap.host || cap.path || '/', iv.pattern || '/') AND contains(iv.pattern, '/'))),
res AS (
  SELECT page_id, url, count(DISTINCT list) AS n_lists, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, min(valid_from) AS since
  FROM hit GROUP BY ALL)
SELECT cap.page_id, fetched_on::DATE AS fetched_on, host, res.page_id IS NOT NULL AS blocked, coalesce(n_lists, 0)::BIGINT AS n_lists,
       coalesce(lists, '') AS lists, since::DATE AS since
FROM cap LEFT JOIN res ON cap.page_id = res.page_id AND cap.url = res.url
"""

DECONTAMINATION = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS span
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, s, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS span
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, lens WHERE len(ws) >= n)),
m AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.span = iw.span AND dw.n = iw.n),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM m GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

# The verdicts of the further rules, as one condition on text ``t`` and its words ``ws``.
_REJECTED = r"""(
     len(ws) < 10 OR 100 * n_repeat_words > 20 * len(ws)
  OR 10 * n_symbols > len(ws)
  OR 2 * n_dup_lines > len(string_split(t, chr(10)))
  OR len(list_filter(ws, lambda x: regexp_matches(x, '^\p{Lu}[\p{Lu}\P{L}]*\p{Lu}[\P{L}]*$'))) > len(ws) * 0.3
  OR 2 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < len(ws)
  OR 10 * len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) > 3 * len(ws)
  OR word_chars < 2 * len(ws) OR word_chars > 15 * len(ws))"""

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 4), ' ') AS span FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, span) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 5)) AS p FROM r) GROUP BY 1),
b AS (
  SELECT d.doc_id, t, ws, len(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       len(ws) < 10 OR 100 * n_repeat_words > 20 * len(ws) AS base_failed, NOT {_REJECTED} AS kept
FROM b
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, s, s + least(len(ws), 4) - 1), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (
  SELECT doc_id AS d, doc_id AS m FROM documents
  UNION SELECT r.d, t.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) t ON t.a = r.m)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(m) FROM r WHERE r.d = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""

LINE_DEDUP = rf"""
WITH x AS (
  SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS parts FROM documents),
l AS (
  SELECT doc_id, k, ws, array_to_string(ws, ' ') AS line, row_number() OVER (ORDER BY doc_id, k) AS o
  FROM (SELECT doc_id, k, {_WORDS.format("parts[k + 1]")} AS ws FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS k FROM x))
  WHERE len(ws) >= 8),
f AS (SELECT line, min(o) AS o, any_value(ws) AS ws FROM l GROUP BY line),
v AS (
  SELECT o, len(ws) AS n, i, md5(array_to_string(list_concat(list_slice(ws, 1, i - 1), list_slice(ws, i + 1, len(ws))), ' ')) AS t
  FROM (SELECT o, ws, unnest(range(1, len(ws) + 1)) AS i FROM f)),
swapped AS (SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY n, i, t) AS least FROM v) WHERE o > least),
grown AS (SELECT greatest(f.o, v.o) AS o FROM v JOIN f ON md5(f.line) = v.t AND f.o <> v.o),
near AS (SELECT o FROM swapped UNION SELECT o FROM grown),
gone AS (
  SELECT l.doc_id, l.k, l.o > f.o AS exact, near.o IS NOT NULL AS near
  FROM l JOIN f ON f.line = l.line LEFT JOIN near ON near.o = f.o WHERE l.o > f.o OR near.o IS NOT NULL),
per AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_exact, count(*) AS n, string_agg(k, ',' ORDER BY k) AS removed FROM gone GROUP BY doc_id)
SELECT x.doc_id, len(parts)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n - n_exact, 0)::BIGINT AS n_near,
       coalesce(removed, '') AS removed
FROM x LEFT JOIN per ON per.doc_id = x.doc_id
"""

SOURCE_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '7', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS place
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS s, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (
  SELECT *, 2.0 * s / w AS ratio, sum(2 * s) OVER q AS below, sum(w) OVER () - sum(w) OVER q AS above, 1.5 * sum(s) OVER () AS total,
         lead(2.0 * s / w) OVER (ORDER BY 2.0 * s / w, source) AS following
  FROM src WINDOW q AS (ORDER BY 2.0 * s / w, source ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT min(l) AS l FROM (
    SELECT (total - below) / above AS l FROM o WHERE above > 0 AND following > (total - below) / above AND ratio <= (total - below) / above
    UNION ALL SELECT max(total) / max(t) FROM (SELECT total, sum(w) OVER () AS t, min(ratio) OVER () AS r FROM o) WHERE r > total / t)),
t AS (
  SELECT source, s, least(2.0 * s, coalesce(l, 1e300) * w) AS target, floor(least(2.0 * s, coalesce(l, 1e300) * w) + 1e-6)::BIGINT AS take FROM src, level),
g AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
a AS (
  SELECT source, place, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place % 4096, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM g)
SELECT d.doc_id, d.size, t.s AS source_size, round(t.target, 3) AS target,
       (d.size * (CASE WHEN t.s > 0 THEN take // t.s ELSE 0 END + CASE WHEN t.s > 0 AND a.ahead + a.words / 2.0 < take % t.s THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN a ON a.source IS NOT DISTINCT FROM d.source AND a.place = d.place
"""
