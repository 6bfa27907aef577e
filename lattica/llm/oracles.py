"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages
), parts AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT p.n, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC, r.verdict DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1
"""

OP7 = r"""
WITH r AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(CAST(page_id AS VARCHAR), 'null')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), ''), chr(10), '') || chr(13) || chr(10) || 'Content-Type: text/html'
    || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages
)
SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256,
       CASE WHEN starts_with(sha256(coalesce(CAST(page_id AS VARCHAR), '')), '00') THEN 'corrupt' ELSE 'intact' END AS status FROM r
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS width
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM bw),
dw AS (
  SELECT n, i, width, array_to_string(w[i : i + width - 1], ' ') AS win FROM d, widths, unnest(range(1, len(w) - width + 2)) AS r(i) WHERE len(w) >= width
), hits AS (SELECT dw.n, dw.i, dw.width, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
words AS (SELECT n, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + width)) AS r(p) GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY n)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON words.n = d.n LEFT JOIN items ON items.n = d.n
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM both_have JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * k >= 4 * (p.n + q.n - k)
), reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
classes AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(c.y, d.doc_id)) AS class_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN classes c ON c.x = d.doc_id LEFT JOIN degrees g ON g.x = d.doc_id
"""

SQL = {
    "op4_ngram_jaccard_join": OP4,
    "op3_url_filters": OP3,
    "op7_warc_fixity": OP7,
    "op8_benchmark_decontamination": OP8,
}
