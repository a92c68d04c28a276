"""SQL that gives the rows of the text operators that SQL can express, for tables whose doc_ids are unique."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NO_SPACE = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Every 100-byte string of every text in the order of its starts; runs of starts that touch are spans.
SUFFIX = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents WHERE doc_id IS NOT NULL),
o AS (SELECT doc_id, b, unnest(generate_series(0, octet_length(b) - 100, 500)) AS o FROM d WHERE octet_length(b) >= 100),
part AS (SELECT doc_id, o, b[o + 1:o + 599] AS b FROM o),
p AS (SELECT doc_id, o, b, unnest(generate_series(1, octet_length(b) - 99)) AS i FROM part),
t AS (SELECT doc_id, o + i AS i, b[i:i + 99] AS t FROM p),
first AS (SELECT t, min({'d': doc_id, 'i': i}) AS f FROM t GROUP BY t),
s AS (SELECT doc_id, i, CASE WHEN f = {'d': doc_id, 'i': i} THEN 1 ELSE 2 END AS k FROM t JOIN first USING (t)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM s WHERE k > 1),
r AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 99 AS hi FROM r GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, octet_length(b) + 1, NULL FROM d),
pieces AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, lo - 1 AS z FROM cuts),
kept AS (SELECT doc_id, string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a) AS x FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(hi - lo + 1) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS ws FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS ws FROM benchmark),
o AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0),
item AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM o),
q AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d JOIN (SELECT DISTINCT n FROM item) ON len(ws) >= n),
m AS (SELECT doc_id, i, q.n AS n, item_id FROM q JOIN item ON item.n = q.n AND item.win = array_to_string(ws[i:i + q.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_NO_SPACE}) AS ws FROM documents WHERE doc_id IS NOT NULL),
o AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM o),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reached AS (SELECT doc_id, doc_id AS origin FROM d UNION SELECT y, origin FROM reached JOIN links ON x = reached.doc_id WHERE origin < y)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(origin) AS component_id FROM d JOIN reached USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

REPEATED_WINDOWS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_NO_SPACE}) AS ws FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS j FROM d),
p AS (SELECT doc_id, j, lead(j, 12) OVER v AS z, concat_ws(' ', {", ".join(f"lead(word, {k}) OVER v" for k in range(13))}) AS win FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY j)),
f AS (SELECT doc_id, j, min(doc_id) OVER (PARTITION BY win) AS first FROM p WHERE z IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(j, j + 12)) AS j FROM f WHERE first < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS x FROM w ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Every document goes through every order by itself; nothing is read off cells of masks.
FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, {_NO_SPACE}) AS ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      concat(CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END, CASE WHEN 100 * caps > 2 * length(t) THEN 'C' ELSE '' END,
             CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN least < doc_id THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l USING (doc_id)),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step:step] AS x, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(generate_series(1, 5)) AS step)),
r AS (SELECT part, filter_order, step, x, contains(fails, x) AS failing, len(regexp_replace(fails, '[^' || before || '_]', '', 'g')) > 0 AS gone, fails = x AS alone, good, toxic FROM f, s),
c AS (SELECT part, filter_order, step, x, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed, count(*) FILTER (gone AND failing) AS redundant,
      count(*) FILTER (alone) AS unique_fails, count(*) FILTER (NOT gone AND failing AND good) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c
"""

#: CRC-32 by its table of 256 entries, made by the rule of its polynomial.
RESAMPLING = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS table_ FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS i)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS ws FROM documents WHERE doc_id IS NOT NULL),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOWER}, {_LETTERS})) AS w FROM benchmark),
ds AS (SELECT w, count(*) AS n FROM dw GROUP BY w), bs AS (SELECT w, count(*) AS n FROM bw GROUP BY w),
v AS (SELECT w FROM ds UNION SELECT w FROM bs),
h AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(generate_series(1, octet_length(encode(w))), lambda k: ('0x' || hex(encode(w))[2 * k - 1:2 * k])::BIGINT)), lambda c, b: xor(c >> 8, table_[1 + (xor(c, b) & 255)]))) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, sum(n) AS s FROM ds JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bs JOIN h USING (w) GROUP BY bucket),
g AS (SELECT w, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM ds) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM bs) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN g USING (w) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN total IS NULL THEN 0 ELSE total // n_features - CASE WHEN total < 0 AND total % n_features <> 0 THEN 1 ELSE 0 END END AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)
"""
