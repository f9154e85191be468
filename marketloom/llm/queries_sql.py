"""DuckDB SQL for the numbered queries that SQL can express on whole tables."""

from __future__ import annotations

from marketloom.llm.quality import STOP_WORDS
from marketloom.llm.urls import BLOCKED_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted({f for words in STOP_WORDS.values() for w in words.split() for f in (w, w.capitalize(), w.upper())}))

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

URLS = rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM b),
r AS (SELECT *, '.' || host AS h FROM c),
m AS (SELECT page_id, host, path,
  CASE WHEN h LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN h LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN h LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
       WHEN h LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN h LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])({"|".join(BLOCKED_WORDS)})([^a-z0-9]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM m
"""

QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, doc_id, text,
  list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
  regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS packed FROM t),
g AS (SELECT rid, unnest(generate_series(1, len(words) - 7)) AS i, words FROM s WHERE len(words) >= 8),
w AS (SELECT rid, i, array_to_string(words[i : i + 7], ' ') AS win FROM g),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM w) x WHERE n > 1),
e AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM d),
n AS (SELECT rid, sum(least(8, i - coalesce(before, -8))) AS covered FROM e GROUP BY rid),
m AS (SELECT s.rid, s.doc_id, len(words)::BIGINT AS n_words, length(packed)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
  (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(list_filter(words, lambda w: w IN ({_STOPS})))::BIGINT AS n_stop_words,
  coalesce(n.covered, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN n ON n.rid = s.rid),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  coalesce(word_chars / nullif(n_words, 0) BETWEEN 2 AND 14
  AND n_symbols / nullif(n_words, 0) <= 0.25 AND n_stop_words / nullif(n_words, 0) >= 0.03
  AND n_upper / nullif(word_chars, 0) <= 0.4 AND n_exclamations / nullif(n_words, 0) <= 0.25
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5, false) AS passed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passed AS kept FROM v
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*)::BIGINT AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT a.lang, a.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN c ON a.lang = c.lang AND a.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS p, 1 + 1000000000 * (k.n + 1) // (v.total + v.v) AS q
  FROM g JOIN v ON g.lang = v.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

NGRAMS = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
k AS MATERIALIZED (SELECT s.rid, s.g FROM s JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) m ON s.g = m.g),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS both_have FROM k a JOIN k b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * both_have >= 85 * (a.n + b.n - both_have)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(rid, least_rid) AS (SELECT rid, rid FROM d UNION SELECT e.y, r.least_rid FROM r JOIN e ON e.x = r.rid WHERE r.least_rid < e.y),
c AS (SELECT rid, min(least_rid) AS least_rid FROM r GROUP BY rid)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, o.doc_id AS component_id FROM d JOIN c ON c.rid = d.rid JOIN d o ON o.rid = c.least_rid LEFT JOIN n ON n.rid = d.rid
"""

SQL = {"op11_ngram_join": NGRAMS, "op12_divergence": DIVERGENCE, "op6_warc": WARC, "op7_quality": QUALITY, "op8_url_filter": URLS}
