"""SQL that says the same as an operator's query, for those that SQL can express."""

from __future__ import annotations

_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS win
 FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
hit AS (SELECT doc_id, p, n, item FROM (SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM iw))) JOIN iw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP2 = f"""WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
cut AS (SELECT DISTINCT doc_id, place FROM (SELECT g.doc_id, unnest(range(p, p + 13)) AS place FROM g JOIN f USING (win) WHERE first < g.doc_id)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY place) AS words FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS place FROM d)
 ANTI JOIN cut USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id) USING (doc_id)"""

OP7 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPLIT} AS ws FROM documents),
g AS (SELECT doc_id, p, ws[p:p + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d)),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS place FROM
 (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(r.n, 0) AS n_repeat_words,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_case, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
 length(regexp_replace(t, '[^!|]', '', 'g')) AS marks FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols / n_words > 0.1
 OR upper_case / greatest(letters, 1) > 0.6 OR marks / n_words > 0.2 OR word_chars / n_words < 2 OR word_chars / n_words > 20
 OR n_dup_lines / greatest(len(lines), 1) > 0.5) AS kept FROM b"""

OP9 = f"""WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS p FROM d),
g AS (SELECT doc_id, p, a AS g1, lag(a) OVER o || ' ' || a AS g2, lag(a, 2) OVER o || ' ' || lag(a) OVER o || ' ' || a AS g3, lag(a) OVER o AS h1,
 lag(a, 2) OVER o || ' ' || lag(a) OVER o AS h2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
own AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest([g1, g2, g3]) AS g FROM g) WHERE g IS NOT NULL GROUP BY ALL),
total AS (SELECT g, sum(n) AS n FROM own GROUP BY g),
rest AS (SELECT doc_id, g, CAST(total.n - own.n AS DOUBLE) AS n FROM own JOIN total USING (g)),
s AS (SELECT g.doc_id, p, CASE WHEN c3.n > 0 THEN ln(c3.n / b2.n) WHEN c2.n > 0 THEN ln(c2.n / b1.n) + ln(0.4) * (least(p, 3) - 2)
  ELSE ln((c1.n + 0.5) / (t.n - len(d.ws) + 1)) + ln(0.4) * (least(p, 3) - 1) END AS score,
 CASE WHEN c3.n > 0 THEN 3 WHEN c2.n > 0 THEN 2 ELSE 1 END < least(p, 3) AS backed
 FROM g JOIN d USING (doc_id) CROSS JOIN (SELECT count(*) AS n FROM w) t JOIN rest c1 ON c1.doc_id = g.doc_id AND c1.g = g1
 LEFT JOIN rest c2 ON c2.doc_id = g.doc_id AND c2.g = g2 LEFT JOIN rest c3 ON c3.doc_id = g.doc_id AND c3.g = g3
 LEFT JOIN rest b1 ON b1.doc_id = g.doc_id AND b1.g = h1 LEFT JOIN rest b2 ON b2.doc_id = g.doc_id AND b2.g = h2)
SELECT d.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(*) FILTER (backed) AS n_backed_off, coalesce(round(sum(score) / len(any_value(ws)), 6), 0.0) AS mean_log_score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""

# Runs of letters, damaged where the checksum of <doc_id>:<run> says so. The checksum's table is made by its polynomial; ids are ASCII, letters
# beyond ASCII are the lead byte 195 and one more.
OP11 = f"""WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i,
  list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
raw AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, w, count(*) AS n FROM (SELECT doc_id,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL),
coded AS (SELECT id, w, n, list_concat(list_transform(string_split(id || ':', ''), lambda c: CAST(unicode(c) AS BIGINT)),
  flatten(list_transform(string_split(w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))) AS b FROM raw),
summed AS (SELECT w, n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || b, lambda c, x: xor(crc[CAST(xor(c, x) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) AS h FROM coded, crc_table),
worn AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM summed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM worn WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM less a JOIN v ON a.rest = v.word UNION SELECT v.word, a.word, a.n FROM less a JOIN v ON a.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
rows AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM rows UNION ALL SELECT chain.word, rows.form FROM chain JOIN rows ON rows.word = chain.root WHERE rows.form IS NOT NULL)
SELECT rows.*, chain.root FROM rows JOIN chain USING (word) JOIN rows last ON last.word = chain.root WHERE last.form IS NULL"""

_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13 = f"""WITH t AS (SELECT place, doc_id, {_TERMS} AS term FROM (SELECT *, row_number() OVER () AS place FROM documents)),
tf AS (SELECT place, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
size AS (SELECT place, sum(tf) AS n FROM tf GROUP BY place),
total AS (SELECT count(*) AS docs, sum(n) AS terms FROM size),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf CROSS JOIN total WHERE term IN (SELECT term FROM q) GROUP BY term),
m AS (SELECT place, 100 - 25 + (25 * n * docs) // terms AS m FROM size CROSS JOIN total),
s AS (SELECT item_id, doc_id, place, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (place) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""
