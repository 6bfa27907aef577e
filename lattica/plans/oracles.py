"""DuckDB SQL for the registered queries; the projections that a text names are put before it."""

LIVE = "superseded_by IS NULL AND deleted_at IS NULL"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
EARLY = "TIMESTAMP '2024-01-03 12:00:00'"
QVEC = "(SELECT embedding FROM embeddings WHERE vec_id = 3)"
COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
GRAMS = "list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def words(x: str) -> str:
    return WORDS.format(x=x)


def grams(x: str) -> str:
    return GRAMS.format(w=words(x))


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce(CAST({both} AS DOUBLE) / nullif(len({a}) + len({b}) - {both}, 0), 0)"


VEC = f"vec AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS rnk FROM (SELECT id, {cos('embedding', QVEC)} AS s FROM v_experiences WHERE {LIVE} AND embedding IS NOT NULL) WHERE s > 0)"
EDGES = """
live_claims AS (SELECT coalesce(a.merged_into, a.id) AS s, coalesce(b.merged_into, b.id) AS o, c.confidence FROM v_claims c JOIN v_entities a ON a.id = c.subject_id JOIN v_entities b ON b.id = c.object_entity_id WHERE c.polarity <> 'retracted'),
edges AS (SELECT s AS src, o AS dst, max(confidence) AS conf FROM (SELECT s, o, confidence FROM live_claims UNION ALL SELECT o, s, confidence FROM live_claims) WHERE s <> o GROUP BY ALL),
seed AS (SELECT coalesce(merged_into, id) AS id FROM v_entities WHERE id = 'c1'),
h0 AS (SELECT id AS node, CAST(1 AS FLOAT) AS conf FROM seed),
h1 AS (SELECT dst AS node, max(CAST(h0.conf * edges.conf AS FLOAT)) AS conf FROM h0 JOIN edges ON src = node WHERE CAST(h0.conf * edges.conf AS FLOAT) >= CAST(0.6 AS FLOAT) AND dst NOT IN (SELECT id FROM seed) GROUP BY 1),
h2 AS (SELECT dst AS node, max(CAST(h1.conf * edges.conf AS FLOAT)) AS conf FROM h1 JOIN edges ON src = node WHERE CAST(h1.conf * edges.conf AS FLOAT) >= CAST(0.6 AS FLOAT) AND dst NOT IN (SELECT id FROM seed) GROUP BY 1),
h3 AS (SELECT dst AS node, max(CAST(h2.conf * edges.conf AS FLOAT)) AS conf FROM h2 JOIN edges ON src = node WHERE CAST(h2.conf * edges.conf AS FLOAT) >= CAST(0.6 AS FLOAT) AND dst NOT IN (SELECT id FROM seed) GROUP BY 1)
"""
CANDIDATES = """
cand AS (SELECT p.k * 100000000 + q.p_partkey AS id, least('p' || p.k, 'p' || q.p_partkey) AS entity_a, greatest('p' || p.k, 'p' || q.p_partkey) AS entity_b,
  CASE WHEN (p.k + q.p_partkey) % 7 = 0 THEN 'kept_separate' ELSE 'pending' END AS status
  FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1) p JOIN part q ON p.p_name = q.p_name AND p.k < q.p_partkey)
"""
FOLD = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
FORMS = f"""
e AS (SELECT id, kind, canonical_name AS n, alias1 AS al FROM v_entities WHERE merged_into IS NULL),
f AS (SELECT DISTINCT id, kind, form FROM (SELECT id, kind, unnest([{FOLD.format(x='n')}, {FOLD.format(x="coalesce(al, '')")}]) AS form FROM e) WHERE form <> ''),
lf AS (SELECT DISTINCT id, kind, lf FROM (SELECT id, kind, unnest([trim(regexp_replace(lower(n), '\\s+', ' ', 'g')), trim(regexp_replace(lower(coalesce(al, '')), '\\s+', ' ', 'g'))]) AS lf FROM e) WHERE lf <> ''),
tok AS (SELECT DISTINCT id, kind, t FROM (SELECT id, kind, unnest(string_split(form, ' ')) AS t FROM f) WHERE length(t) >= 3)
"""
QUEUE = f"""
q AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'in_progress' WHEN event_id % 4 = 3 THEN 'complete' ELSE 'pending' END AS status, event_id % 4 AS attempts,
  CASE WHEN event_id % 5 <> 0 THEN {NOW} - to_minutes(CAST(event_id % 60 AS INTEGER)) END AS attempted_at, ts AS captured_at FROM events),
rec AS (SELECT id, captured_at, attempted_at, CASE WHEN status = 'in_progress' AND attempted_at < {NOW} - INTERVAL 15 MINUTE THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts,
  CASE WHEN status = 'in_progress' AND attempted_at < {NOW} - INTERVAL 15 MINUTE THEN 'pending' ELSE status END AS status FROM q),
elig AS (SELECT *, status = 'pending' AND attempts < 3 AND (attempted_at IS NULL OR attempts = 0 OR attempted_at <= {NOW} - CASE WHEN attempts <= 1 THEN INTERVAL 5 MINUTE ELSE INTERVAL 30 MINUTE END) AS due FROM rec)
"""
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def snippet(x: str, n: int) -> str:
    t = STRIP.format(x=x)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace(substr({t}, 1, {n}), '\\s+$', '') || '…' END"


def esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


TIED = "EXISTS (SELECT 1 FROM v_claims c WHERE c.polarity <> 'retracted' AND (c.subject_id = {e} OR c.object_entity_id = {e}))"

SQL = {
    "hybrid_rrf_topk": f"""
WITH {VEC},
lw AS (SELECT id, w, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'of')) AS b FROM (SELECT id, {words('content')} AS w FROM v_experiences WHERE {LIVE})),
lex AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS rnk FROM (SELECT id, (a + b) / len(w) AS s FROM lw WHERE a > 0 AND b > 0)),
fused AS (SELECT id, max(v) AS v, max(l) AS l, sum(part) AS f FROM (SELECT id, s AS v, 0 AS l, 1.0::DOUBLE / (60 + rnk) AS part FROM vec WHERE rnk <= 50 UNION ALL SELECT id, 0, s, 1.0::DOUBLE / (60 + rnk) FROM lex WHERE rnk <= 50) GROUP BY id)
SELECT id, round(v, 6) AS vec_score, round(l, 6) AS lex_score, round(f, 6) AS fused_score FROM fused ORDER BY f DESC, v DESC, l DESC, id LIMIT 10""",
    "vector_topk": f"WITH {VEC} SELECT id, round(s, 6) AS score, rnk AS rank FROM vec WHERE rnk <= 20",
    "vector_batch_topk": f"""
WITH s AS (SELECT q.vec_id AS query_id, e.id, {cos('e.embedding', 'q.embedding')} AS s FROM embeddings q, v_experiences e WHERE q.vec_id % 50 = 0 AND e.embedding IS NOT NULL AND {LIVE}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s WHERE s > 0)
SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 5""",
    "legacy_threshold_search": f"SELECT id, round(s, 6) AS similarity FROM (SELECT id, {cos('embedding', QVEC)} AS s FROM v_experiences WHERE embedding IS NOT NULL) WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 50",
    "list_filtered": f"""
SELECT id, captured_at AS created_at FROM v_experiences WHERE (owner = '3' OR visibility = 'shared') AND meta_type = 'view' AND 'en' IN (meta_topic1, meta_topic2) AND captured_at >= {NOW} - INTERVAL 30 DAY
ORDER BY captured_at DESC, id LIMIT 50""",
    "recent_feed": f"""
WITH top AS (SELECT * FROM v_experiences WHERE {LIVE} ORDER BY captured_at DESC, id LIMIT 20),
tags AS (SELECT m.experience_id, string_agg(n.canonical_name, '|' ORDER BY n.canonical_name, n.kind, n.id) AS names FROM (SELECT DISTINCT experience_id, entity_id FROM v_mentions) m JOIN v_entities n ON n.id = m.entity_id AND n.merged_into IS NULL GROUP BY 1)
SELECT id, {snippet('content', 280)} AS snippet, captured_at, visibility, lat, lng, coalesce(names, '') AS names FROM top LEFT JOIN tags ON tags.experience_id = top.id""",
    "day_buckets": f"""
WITH b AS (SELECT CASE WHEN CAST(captured_at AS DATE) >= DATE '2024-01-03' THEN 'today' WHEN CAST(captured_at AS DATE) = DATE '2024-01-02' THEN 'yesterday' WHEN CAST(captured_at AS DATE) >= date_trunc('week', DATE '2024-01-03') THEN 'this-week' ELSE 'earlier' END AS bucket FROM v_experiences WHERE {LIVE})
SELECT bucket, CAST(list_position(['today', 'yesterday', 'this-week', 'earlier'], bucket) AS INTEGER) AS bucket_order, count(*) AS n FROM b GROUP BY bucket""",
    "recall_window": f"""
SELECT id, captured_at, CAST(0 AS DOUBLE) AS fused_score FROM v_experiences WHERE captured_at >= {EARLY} - INTERVAL 2 DAY AND (owner = '3' OR visibility = 'shared') AND source_kind = 'derived' ORDER BY captured_at DESC, id LIMIT 20""",
    "who_was_at_date": """
WITH r AS (SELECT n.id AS entity_id, n.canonical_name, n.kind, m.surface_form, row_number() OVER (PARTITION BY n.id ORDER BY m.field, m.experience_id, m.surface_form) AS k
  FROM v_experiences e JOIN v_mentions m ON m.experience_id = e.id JOIN v_entities n ON n.id = m.entity_id
  WHERE CAST(e.occurred_at AS DATE) = DATE '2024-01-01' OR (e.occurred_at IS NULL AND CAST(e.captured_at AS DATE) = DATE '2024-01-01'))
SELECT entity_id, canonical_name, kind, surface_form FROM r WHERE k = 1""",
    "who_was_at_experience": "SELECT DISTINCT n.id AS entity_id, n.canonical_name, n.kind, m.surface_form FROM v_mentions m JOIN v_entities n ON n.id = m.entity_id JOIN v_experiences e ON e.id = m.experience_id WHERE m.experience_id = 1",
    "entity_timeline": f"""
SELECT e.id, e.captured_at, e.occurred_at, m.surface_form FROM v_experiences e JOIN (SELECT experience_id, min(surface_form) AS surface_form FROM v_mentions WHERE entity_id = 'p7' GROUP BY 1) m ON m.experience_id = e.id
WHERE {LIVE} ORDER BY e.occurred_at DESC NULLS LAST, e.captured_at DESC, e.id LIMIT 50""",
    "entity_mention_counts": f"SELECT m.entity_id, count(DISTINCT m.experience_id) AS mention_count FROM v_mentions m JOIN v_experiences e ON e.id = m.experience_id WHERE {LIVE} AND (owner = '3' OR visibility = 'shared') GROUP BY 1",
    "recently_active": f"""
WITH a AS (SELECT n.id, n.canonical_name, n.kind, max(e.captured_at) AS last_seen FROM v_mentions m JOIN v_experiences e ON e.id = m.experience_id JOIN v_entities n ON n.id = m.entity_id
  WHERE {LIVE} AND n.merged_into IS NULL AND e.captured_at > {NOW} - INTERVAL 30 DAY GROUP BY ALL ORDER BY last_seen DESC, n.id LIMIT 20),
s AS (SELECT *, epoch({NOW}) - floor(epoch(last_seen)) AS secs FROM a)
SELECT id, canonical_name, kind, last_seen, CASE WHEN secs < 60 THEN 'now' WHEN secs < 3600 THEN CAST(CAST(floor(secs / 60) AS BIGINT) AS VARCHAR) || 'm' WHEN secs < 86400 THEN CAST(CAST(floor(secs / 3600) AS BIGINT) AS VARCHAR) || 'h' ELSE CAST(CAST(floor(secs / 86400) AS BIGINT) AS VARCHAR) || 'd' END AS recency FROM s""",
    "summary_counts": f"""
SELECT (SELECT count(*) FROM v_experiences WHERE {LIVE}) AS experience_count, (SELECT min(captured_at) FROM v_experiences WHERE {LIVE}) AS earliest, (SELECT max(captured_at) FROM v_experiences WHERE {LIVE}) AS latest,
  (SELECT count(*) FROM v_entities WHERE merged_into IS NULL) AS entity_count, (SELECT count(*) FROM v_claims WHERE polarity <> 'retracted') AS claim_count""",
    "top_entities": "SELECT n.id, n.canonical_name, n.kind, count(*) AS mention_count FROM v_mentions m JOIN v_entities n ON n.id = m.entity_id WHERE n.merged_into IS NULL GROUP BY ALL ORDER BY mention_count DESC, n.canonical_name, n.id LIMIT 10",
    "top_topics": f'SELECT topic, count(*) AS "count" FROM (SELECT unnest([meta_topic1, meta_topic2]) AS topic FROM v_experiences WHERE {LIVE}) GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 10',
    "type_histogram": "SELECT meta_type AS type, count(*) AS \"count\" FROM v_experiences WHERE owner = '3' OR visibility = 'shared' GROUP BY 1",
    "pending_review_counts": f"""
WITH {CANDIDATES}, n AS (SELECT (SELECT count(*) FROM cand WHERE status = 'pending') AS merge_candidates,
  (SELECT count(*) FROM v_claims c JOIN v_claim_sources s ON s.claim_id = c.id WHERE s.support_kind = 'inferred' AND c.confidence < CAST(0.6 AS FLOAT) AND c.polarity <> 'retracted') AS low_confidence_claims,
  (SELECT count(*) FROM v_claims WHERE superseded_by IS NOT NULL AND polarity <> 'retracted') AS contradictions, CAST(0 AS BIGINT) AS disambiguations, CAST(0 AS BIGINT) AS proposed_corrections)
SELECT *, merge_candidates + low_confidence_claims + contradictions AS total FROM n""",
    "low_confidence_queue": """
SELECT c.id AS claim_id, s.experience_id, round(CAST(c.confidence AS DOUBLE), 6) AS confidence FROM v_claims c JOIN v_claim_sources s ON s.claim_id = c.id
WHERE s.support_kind = 'inferred' AND c.confidence < CAST(0.6 AS FLOAT) AND c.polarity <> 'retracted' ORDER BY c.confidence, c.created_at, c.id LIMIT 200""",
    "contradictions": "SELECT id, subject_id, predicate, superseded_by FROM v_claims WHERE superseded_by IS NOT NULL AND polarity <> 'retracted'",
    "split_candidates": """
WITH e AS (SELECT subject_id AS stored, id FROM v_claims WHERE polarity <> 'retracted' UNION SELECT object_entity_id, id FROM v_claims WHERE polarity <> 'retracted'),
d AS (SELECT coalesce(n.merged_into, n.id) AS id, count(DISTINCT e.id) AS degree FROM e JOIN v_entities n ON n.id = e.stored GROUP BY 1 HAVING count(DISTINCT e.id) >= 5)
SELECT d.id, d.degree, n.canonical_name, n.kind FROM d JOIN v_entities n ON n.id = d.id ORDER BY degree DESC, d.id LIMIT 20""",
    "impact_gate_deferred": f"""
WITH {CANDIDATES}, cnt AS (SELECT coalesce(n.merged_into, n.id) AS s, count(DISTINCT m.experience_id) AS n FROM v_mentions m JOIN v_entities n ON n.id = m.entity_id GROUP BY 1),
touched AS (SELECT DISTINCT e FROM (SELECT subject_id AS e FROM v_claims WHERE polarity <> 'retracted' UNION ALL SELECT object_entity_id FROM v_claims WHERE polarity <> 'retracted') WHERE e IS NOT NULL)
SELECT c.id, a.kind = 'concept' AND b.kind = 'concept' AND c.entity_a NOT IN (SELECT e FROM touched) AND c.entity_b NOT IN (SELECT e FROM touched) AND coalesce(ca.n, 0) <= 1 AND coalesce(cb.n, 0) <= 1 AS deferred
FROM cand c JOIN v_entities a ON a.id = c.entity_a JOIN v_entities b ON b.id = c.entity_b LEFT JOIN cnt ca ON ca.s = coalesce(a.merged_into, a.id) LEFT JOIN cnt cb ON cb.s = coalesce(b.merged_into, b.id)""",
    "provenance_block": """
SELECT s.experience_id, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.confidence DESC NULLS LAST, c.created_at, c.id) AS claims FROM v_claim_sources s JOIN v_claims c ON c.id = s.claim_id
JOIN v_experiences e ON e.id = s.experience_id WHERE c.polarity <> 'retracted' AND (c.confidence IS NULL OR c.confidence >= 0.6) GROUP BY 1""",
    "salience_decay": f"""
WITH w AS (SELECT target_id, sum(CASE outcome WHEN 'helpful' THEN 1.0 WHEN 'wrong' THEN -0.5 ELSE 0.0 END * exp(-(epoch_us({NOW}) - epoch_us(recalled_at)) / 1e6 / (30 * 86400))) AS s FROM v_recall_events WHERE target_kind = 'experience' AND recalled_at > {NOW} - INTERVAL 180 DAY GROUP BY 1)
SELECT t.id, round(CAST(CAST(coalesce(w.s, 0) AS FLOAT) AS DOUBLE), 4) AS salience FROM (SELECT DISTINCT user_id AS id FROM events) t LEFT JOIN w ON w.target_id = t.id""",
    "salience_from_windows": f"""
SELECT target_kind, target_id, round(sum(CASE outcome WHEN 'helpful' THEN 1.0::DOUBLE WHEN 'wrong' THEN -0.5 ELSE 0.0 END * exp(-(epoch_us({NOW}) - epoch_us(recalled_at)) / 1e6 / (30 * 86400))), 6) AS salience FROM v_recall_events GROUP BY ALL""",
    "relationships_2hop": f"""
WITH {EDGES}, r AS (SELECT node, min(h) AS hops, max(conf) AS conf FROM (SELECT node, 1 AS h, conf FROM h1 UNION ALL SELECT node, 2, conf FROM h2) GROUP BY 1)
SELECT node AS entity_id, canonical_name, kind, CAST(hops AS BIGINT) AS hops, round(CAST(conf AS DOUBLE), 6) AS confidence FROM r JOIN v_entities n ON n.id = node""",
    "relationships_3hop": f"""
WITH {EDGES}, r AS (SELECT node, min(h) AS hops, max(conf) AS conf FROM (SELECT node, 1 AS h, conf FROM h1 UNION ALL SELECT node, 2, conf FROM h2 UNION ALL SELECT node, 3, conf FROM h3) GROUP BY 1)
SELECT CAST(hops AS BIGINT) AS hops, count(*) AS n, round(CAST(max(conf) AS DOUBLE), 6) AS best FROM r GROUP BY 1""",
    "survivor_flatten": "SELECT id, merged_into AS terminal, CAST(1 AS BIGINT) AS hops FROM v_entities WHERE merged_into IS NOT NULL",
    "mention_ids_by_name": """
WITH hit AS (SELECT id FROM v_entities WHERE kind = 'concept' AND (lower(trim(canonical_name)) = (SELECT lower(trim(p_name)) FROM part WHERE p_partkey = 1) OR lower(trim(alias1)) = (SELECT lower(trim(p_name)) FROM part WHERE p_partkey = 1)))
SELECT DISTINCT experience_id AS id FROM v_mentions WHERE entity_id IN (SELECT id FROM hit UNION SELECT id FROM v_entities WHERE merged_into IN (SELECT id FROM hit))""",
    "bbox_contiguous": f"SELECT id, lat, lng FROM v_experiences WHERE {LIVE} AND lat BETWEEN -30 AND 45 AND lng BETWEEN -60 AND 80 ORDER BY occurred_at DESC NULLS LAST, captured_at DESC, id LIMIT 500",
    "bbox_antimeridian": f"SELECT id, lat, lng FROM v_experiences WHERE {LIVE} AND lat BETWEEN -90 AND 90 AND (lng >= 120 OR lng <= -120) ORDER BY occurred_at DESC NULLS LAST, captured_at DESC, id LIMIT 500",
    "activity_typed": """
WITH t AS (SELECT event_id AS id, event_type AS t, ts, CASE WHEN event_type = 'purchase' THEN 'claim' WHEN event_type IN ('view', 'click') THEN 'entity' ELSE 'experience' END AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)
SELECT t.id, CASE WHEN t.t = 'purchase' THEN 'retract' WHEN t.t = 'click' THEN 'merge' WHEN t.t = 'view' THEN 'rename' WHEN t.t = 'error' THEN 'delete' ELSE 'visibility' END AS change_type,
  CASE WHEN t.id % 3 = 0 THEN 'human' WHEN t.id % 3 = 1 THEN 'auto' ELSE 'system' END AS actor, n.canonical_name AS entity_name, w.canonical_name AS winner_name, c.predicate AS claim_predicate
FROM t LEFT JOIN v_entities n ON t.k = 'entity' AND n.id = 'c' || (t.id % 100 + 1) LEFT JOIN v_entities w ON t.t = 'click' AND w.id = 'c1' LEFT JOIN v_claims c ON t.k = 'claim' AND c.id = t.id""",
    "orphan_claims": f"""
SELECT c.id FROM v_claims c WHERE c.polarity <> 'retracted' AND c.id IN (SELECT s.claim_id FROM v_claim_sources s JOIN v_experiences e ON e.id = s.experience_id WHERE e.deleted_at IS NOT NULL)
  AND c.id NOT IN (SELECT s.claim_id FROM v_claim_sources s JOIN v_experiences e ON e.id = s.experience_id WHERE {LIVE})""",
    "claim_binding_index": f"""
WITH m AS (SELECT DISTINCT n.kind, {FOLD.format(x='m.surface_form')} AS norm, coalesce(n.merged_into, n.id) AS s FROM v_mentions m JOIN v_entities n ON n.id = m.entity_id), k AS (SELECT * FROM m WHERE norm <> ''),
w AS (SELECT kind, norm, min(s) AS entity_id FROM k GROUP BY 1, 2 HAVING count(DISTINCT s) = 1),
g AS (SELECT kind, split_part(norm, ' ', 1) AS norm, min(s) AS entity_id FROM k WHERE kind = 'person' AND contains(norm, ' ') GROUP BY 1, 2 HAVING count(DISTINCT s) = 1)
SELECT * FROM w UNION ALL SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.kind = g.kind AND k.norm = g.norm)""",
    "token_blocks": f"""
WITH {FORMS}, sized AS (SELECT kind, t, count(*) AS size FROM tok GROUP BY ALL HAVING count(*) > 1)
SELECT 't|' || kind || '|' || t AS key, id, size FROM tok JOIN sized USING (kind, t)""",
    "exact_dup_merge_plan": f"""
WITH {FORMS}, s AS (SELECT DISTINCT x.id AS a, y.id AS b FROM lf x JOIN lf y ON x.kind = y.kind AND x.lf = y.lf AND x.id < y.id WHERE x.kind <> 'person'),
w AS (SELECT s.a, s.b, (x.al IS NOT NULL, length(x.n)) >= (y.al IS NOT NULL, length(y.n)) AS left_wins FROM s JOIN e x ON x.id = s.a JOIN e y ON y.id = s.b)
SELECT CASE WHEN left_wins THEN b ELSE a END AS loser, CASE WHEN left_wins THEN a ELSE b END AS winner, CAST(1 AS DOUBLE) AS score FROM w""",
    "fs_match_probability": f"""
WITH {FORMS}, s AS (SELECT DISTINCT x.id AS a, y.id AS b FROM f x JOIN f y ON x.kind = y.kind AND x.form = y.form AND x.id < y.id JOIN tok t ON t.id = x.id AND contains(' ' || x.form || ' ', ' ' || t.t || ' ') WHERE x.kind <> 'person'),
l AS (SELECT DISTINCT x.id AS a, y.id AS b FROM lf x JOIN lf y ON x.kind = y.kind AND x.lf = y.lf AND x.id < y.id)
SELECT s.a, s.b, round(1 / (1 + pow(2.0::DOUBLE, -CASE WHEN l.a IS NOT NULL THEN 9.0::DOUBLE ELSE 2.4 END)), 6) AS score FROM s LEFT JOIN l ON l.a = s.a AND l.b = s.b""",
    "contested_entities": f"""
WITH {CANDIDATES}, b AS (SELECT entity_a AS id, entity_b AS p FROM cand WHERE status = 'pending' UNION SELECT entity_b, entity_a FROM cand WHERE status = 'pending')
SELECT DISTINCT x.id FROM b x JOIN b y ON x.id = y.id AND x.p < y.p WHERE NOT EXISTS (SELECT 1 FROM b z WHERE z.id = x.p AND z.p = y.p)""",
    "held_pairs": f"""
WITH {CANDIDATES}, d AS (SELECT coalesce(a.merged_into, a.id) AS x, coalesce(b.merged_into, b.id) AS y FROM cand c JOIN v_entities a ON a.id = c.entity_a JOIN v_entities b ON b.id = c.entity_b WHERE c.status IN ('kept_separate', 'skipped'))
SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM d WHERE x <> y""",
    "trigram_similarity_topk": f"""
WITH q AS (SELECT {grams('p_name')} AS g FROM part WHERE p_partkey = 2),
e AS (SELECT id, {grams('canonical_name')} AS a, {grams("coalesce(alias1, '')")} AS b FROM v_entities WHERE kind = 'concept' AND merged_into IS NULL),
s AS (SELECT id, CAST(greatest({jaccard('e.a', 'q.g')}, {jaccard('e.b', 'q.g')}) AS FLOAT) AS s FROM e, q),
r AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS rank FROM s WHERE s >= CAST(0.3 AS FLOAT))
SELECT id, round(CAST(s AS DOUBLE), 5) AS score, rank FROM r WHERE rank <= 50""",
    "resolve_batch_topk": f"""
WITH q AS (SELECT id AS query_id, kind, {grams('canonical_name')} AS g FROM v_entities WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0),
e AS (SELECT id, kind, {grams('canonical_name')} AS g FROM v_entities WHERE merged_into IS NULL UNION ALL SELECT id, kind, {grams('alias1')} FROM v_entities WHERE merged_into IS NULL AND alias1 IS NOT NULL),
s AS (SELECT query_id, id, max(CAST({jaccard('e.g', 'q.g')} AS FLOAT)) AS s FROM e JOIN q ON e.kind = q.kind GROUP BY 1, 2),
r AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s WHERE s >= CAST(0.3 AS FLOAT))
SELECT query_id, id AS entity_id, round(CAST(s AS DOUBLE), 5) AS trgm_score, rank FROM r WHERE rank <= 5""",
    "jaro_winkler_pairs": """
WITH n AS (SELECT p_name AS x FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer), p AS (SELECT a.x, b.x AS y FROM n a JOIN n b ON substr(a.x, 1, 2) = substr(b.x, 1, 2) AND a.x < b.x),
j AS (SELECT x, y, jaro_similarity(x, y) AS j, CASE WHEN substr(x, 1, 4) = substr(y, 1, 4) THEN least(4, length(x), length(y)) WHEN substr(x, 1, 3) = substr(y, 1, 3) THEN 3 ELSE 2 END AS k FROM p)
SELECT x, y, round(j + k * 0.1 * (1 - j), 6) AS similarity FROM j""",
    "id_set_intersection": "SELECT DISTINCT experience_id AS id FROM v_mentions WHERE field = 'people' AND experience_id IN (SELECT experience_id FROM v_mentions WHERE field = 'topics')",
    "orphan_keys_anti": "SELECT DISTINCT o_orderkey AS object_key FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)",
    "retry_eligibility": f"WITH {QUEUE} SELECT id, status, CAST(attempts AS BIGINT) AS attempts, due FROM elig",
    "retry_pick": f"WITH {QUEUE} SELECT id FROM elig WHERE due ORDER BY attempted_at NULLS FIRST, captured_at, id LIMIT 50",
    "edit_decision": f"""
WITH s AS (SELECT o.id, {cos('o.embedding', 'n.embedding')} AS s FROM v_experiences o JOIN v_experiences n ON n.id - 1 = o.id)
SELECT id, round(s, 6) AS similarity, CASE WHEN coalesce(s, 0) > 0.95 THEN 'in_place' ELSE 'superseded' END AS decision FROM s""",
    "excerpt_snippet": f"""
WITH t AS (SELECT id, content AS c, strpos(lower(content), 'the') - 1 AS p0 FROM v_experiences),
w AS (SELECT *, CASE WHEN length(c) > 200 THEN greatest(p0 - 98, 0) ELSE 0 END AS a, CASE WHEN length(c) > 200 THEN least(p0 + 3 + 98, length(c)) ELSE length(c) END AS b FROM t)
SELECT id, {snippet('c', 280)} AS snippet, CASE WHEN p0 >= 0 THEN CASE WHEN a > 0 THEN '…' ELSE '' END || {esc('substr(c, a + 1, p0 - a)')} || '<mark>' || {esc('substr(c, p0 + 1, 3)')} || '</mark>' || {esc('substr(c, p0 + 4, b - p0 - 3)')} || CASE WHEN b < length(c) THEN '…' ELSE '' END
  WHEN length(c) > 200 THEN {esc('substr(c, 1, 200)')} || '…' ELSE {esc('c')} END AS excerpt FROM w""",
    "claim_source_counts": """
SELECT c.id, n.n AS source_count, p.n AS claim_count FROM v_claims c JOIN v_claim_sources s ON s.claim_id = c.id JOIN (SELECT claim_id, count(*) AS n FROM v_claim_sources GROUP BY 1) n ON n.claim_id = c.id
JOIN (SELECT experience_id, count(*) AS n FROM v_claim_sources GROUP BY 1) p ON p.experience_id = s.experience_id""",
    "top_people_first_seen": """
WITH s AS (SELECT m.surface_form AS name, m.experience_id AS x, e.captured_at AS t FROM v_mentions m JOIN v_experiences e ON e.id = m.experience_id WHERE m.field = 'people'),
r AS (SELECT name, row_number() OVER (ORDER BY t DESC, x) AS k FROM s)
SELECT name, count(*) AS "count" FROM r GROUP BY name ORDER BY count(*) DESC, min(k) LIMIT 10""",
    "person_topic_search": f"""
WITH n AS (SELECT lower(trim(p_name)) AS s FROM part WHERE p_partkey = 1),
hit AS (SELECT id FROM v_entities WHERE kind = 'concept' AND (lower(trim(canonical_name)) = (SELECT s FROM n) OR lower(trim(alias1)) = (SELECT s FROM n))),
ids AS (SELECT DISTINCT experience_id AS id FROM v_mentions WHERE entity_id IN (SELECT id FROM hit UNION SELECT id FROM v_entities WHERE merged_into IN (SELECT id FROM hit)))
SELECT id, round(s, 6) AS score FROM (SELECT id, {cos('embedding', QVEC)} AS s FROM v_experiences WHERE {LIVE} AND embedding IS NOT NULL AND id IN (SELECT id FROM ids)) WHERE s > 0 ORDER BY s DESC, id LIMIT 20""",
}
