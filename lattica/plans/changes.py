"""Registered queries of state changes, details and writers, each with its DuckDB equivalent beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import names as N
from lattica.functions import text as X
from lattica.functions.lexical import lexical_channel
from lattica.functions.predicates import editable
from lattica.operators import aggregates, flows, graph, lifecycle, listings, resolve, review, search
from lattica.plans import oracles as O
from lattica.plans.base import EARLY, entities, merge_candidates, now, r6, vector
from lattica.sources import durable as store
from lattica.sources.views import Memory

EVENTS = "id long, target_kind string, target_id string, before string, after string, reason string, created_at timestamp, created_by string"
#: Two words with a meaning, for the full-text channel.
CONTENT = '"anea" OR erin thble -thsh'
BY = "query"


def named(df: DataFrame) -> DataFrame:
    return df.select("id", "canonical_name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "|").alias("aliases"), "merged_into")


def merge_two(m: Memory) -> DataFrame:
    return named(lifecycle.merge(entities(m), None, "s2", "s1", now(), BY).tables["entities"])


def unmerge_one(m: Memory) -> DataFrame:
    first = m.entities.where("merged_into IS NOT NULL").agg(F.min_by("id", F.expr("CAST(substr(id, 2) AS BIGINT)"))).first()[0]
    return lifecycle.unmerge(entities(m), m.spark.createDataFrame([], EVENTS), None, first, now(), BY).tables["entities"].select("id", "merged_into")


def rename_one(m: Memory) -> DataFrame:
    return named(lifecycle.rename(entities(m), "s1", "Renamed", now(), BY).tables["entities"])


def append_alias_one(m: Memory) -> DataFrame:
    return named(lifecycle.append_alias(lifecycle.append_alias(entities(m), "c1", "also"), "c1", "also"))


def retract_one(m: Memory) -> DataFrame:
    first = m.claims.where("polarity <> 'retracted'").agg(F.min("id")).first()[0]
    return lifecycle.retract_claim(m.claims, first, "wrong", now(), BY).tables["claims"].select("id", "polarity")


def delete_one(m: Memory) -> DataFrame:
    return lifecycle.soft_delete(m.experiences, m.claims, m.claim_sources, 1, now().cast("timestamp_ntz"), BY).tables["claims"].select("id", "polarity")


def share_one(m: Memory) -> DataFrame:
    return lifecycle.set_visibility(m.experiences, 1, "shared", None, now(), BY).tables["experiences"].select("id", "visibility")


def patch_one(m: Memory) -> DataFrame:
    change = lifecycle.patched(m.experiences, 2, {"source_kind": "derived", "owner": "somebody"}, now(), BY)
    return change.tables["experiences"].select("id", "source_kind", "owner")


def split_one(m: Memory) -> DataFrame:
    """Half of the experiences of whoever is mentioned first go to a new entity."""
    who = m.mentions.where("field = 'people'").agg(F.min_by("entity_id", "experience_id")).first()[0]
    scope = m.experiences.where("id % 2 = 0").select("id")
    change = lifecycle.split_entity(entities(m), m.mentions, m.claims, m.claim_sources, who, {"id": "new", "canonical_name": "New"}, scope, now(), BY)
    return change.tables["mentions"].select("experience_id", "entity_id", "surface_form", "field")


def split_claims_one(m: Memory) -> DataFrame:
    """All claims of one experience name a new subject instead of the customer."""
    who, where = m.claims.join(m.claim_sources, F.col("id") == F.col("claim_id")).agg(F.min_by("subject_id", "experience_id"), F.min("experience_id")).first()
    change = flows.split_claims(entities(m), m.claims, m.claim_sources, who, {"id": "new", "canonical_name": "New"}, where, "wrong", now(), BY)
    return change.tables["claims"].select("id", "subject_id", "object_entity_id")


def chain_flatten(m: Memory) -> DataFrame:
    """Chains of up to nine merges among the parts, flattened with their audit rows."""
    to = F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit("p"), (F.col("p_partkey") - 1).cast("string")))
    chained = m.spark.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), to.alias("merged_into"))
    change = lifecycle.flatten(chained, now(), BY)
    moved = change.audit.select(F.col("target_id").alias("id"), F.lit(True).alias("moved"))
    return change.tables["entities"].join(moved, "id", "left").select("id", "merged_into", F.coalesce("moved", F.lit(False)).alias("moved"))


def chain_ends(m: Memory) -> DataFrame:
    to = F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit("p"), (F.col("p_partkey") - 1).cast("string")))
    chained = m.spark.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), to.alias("merged_into"))
    return graph.flatten_chains(chained).select("id", "terminal", "hops")


def claims_bound(m: Memory) -> DataFrame:
    """Extracted claims, each person with each topic of an experience, bound to entities by the index."""
    said = lambda field, name: m.mentions.where(F.col("field") == field).select("experience_id", F.col("surface_form").alias(name)).distinct()
    claims = said("people", "subject").join(said("topics", "object"), "experience_id").withColumns({"subject_kind": F.lit("person"), "object_kind": F.lit("concept")})
    return lifecycle.claims_to_write(claims, resolve.binding_index(m.mentions, m.entities)).select("experience_id", "subject_id", "object", "object_entity_id", "object_literal")


def entity_usage(m: Memory) -> DataFrame:
    return aggregates.usage("p7", m.claims, m.mentions).withColumn("surface_forms", F.array_join("surface_forms", "|"))


def merge_evidence(m: Memory) -> DataFrame:
    return review.evidence(merge_candidates(m), m.mentions, m.experiences).select("entity_id", "experience_id", "snippet", F.col("k").cast("long").alias("k"))


def merge_queue_shown(m: Memory) -> DataFrame:
    return review.merge_queue(merge_candidates(m), m.entities, m.claims, m.mentions)[0].select("id", "entity_a", "name_a", "entity_b", "name_b")


def experience_claims(m: Memory) -> DataFrame:
    out = listings.experience_detail(1, m.experiences, m.mentions, m.entities, m.claims, m.claim_sources)["claims"]
    return out.select("claim_id", "support_kind", "predicate", "object_name")


def entity_claims(m: Memory) -> DataFrame:
    out = listings.entity_detail("c1", m.entities, m.claims, m.claim_sources, m.mentions, m.experiences)
    return out["as_subject"].select("id", "predicate", "source_count")


def feed_second_page(m: Memory) -> DataFrame:
    return listings.recent_feed(m.experiences, m.mentions, m.entities, limit=20, offset=20).select("id", "captured_at")


def mentions_counted(m: Memory) -> DataFrame:
    page, total, more = listings.counted_page(m.mentions.where("entity_id = 'p7'").orderBy("experience_id", "surface_form"), 3, 1)
    return page.select("experience_id", F.lit(total).cast("long").alias("total"), F.lit(more).alias("more"))


def paraphrased_claims(m: Memory) -> DataFrame:
    return review.sources_by_kind(m.claims, m.claim_sources, m.experiences.select("id"), "paraphrased")


def thoughts_view(m: Memory) -> DataFrame:
    listings.thoughts(m.experiences).createOrReplaceTempView("thoughts")
    return m.spark.sql("SELECT id, created_at, content FROM thoughts")


def canonical_pair_rows(m: Memory) -> DataFrame:
    pairs = merge_candidates(m).select("entity_a", "entity_b")
    return store.canonical_pairs(pairs.union(pairs.select("entity_b", "entity_a")).union(pairs.select("entity_a", "entity_a")))


def upsert_coalesced(m: Memory) -> DataFrame:
    """The names that parts lack are filled from suppliers of the same number; suppliers beyond them are new rows."""
    old = m.spark.table("part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"))
    return store.upsert_coalesce(old, m.spark.table("supplier").select((F.col("s_suppkey") * 40).alias("k"), F.col("s_name").alias("name")), "k")


def inserted_if_absent(m: Memory) -> DataFrame:
    """The customers appended to a table that holds every second one already."""
    path = f"{store.shared_folder(m.spark)}/lattica-customers-{uuid.uuid4().hex}"
    rows = m.spark.table("customer").select(F.col("c_custkey").alias("id"))
    store.append_if_absent(rows.where("id % 2 = 0"), path, ["id"])
    return store.append_if_absent(rows, path, ["id"])


def snapshot_manifest(m: Memory) -> DataFrame:
    path = f"{store.shared_folder(m.spark)}/lattica-snapshot-{uuid.uuid4().hex}"
    return store.snapshot({"experiences": m.experiences, "entities": m.entities, "claims": m.claims, "mentions": m.mentions}, path)


def field_formats(m: Memory) -> DataFrame:
    """Times, object keys, degrees and who may edit, of every experience."""
    degrees = X.decimal_degrees(F.col("id") % 90 + 1, F.col("id") % 60, F.col("id") % 7, F.when(F.col("id") % 2 == 0, "s").otherwise("N"))
    return m.experiences.select("id", X.iso_z(F.col("captured_at")).alias("iso"), X.content_key(F.col("owner"), F.col("content")).alias("key"), F.round(degrees, 6).alias("degrees"), editable("3").alias("mine"))


def name_parts(m: Memory) -> DataFrame:
    x = N.parts(X.folded(F.col("canonical_name")))
    return m.entities.select("id", x.alias("x")).select("id", "x.core", F.col("x.n").cast("long").alias("n"), "x.suffix", "x.numbers")


def asked_names(m: Memory) -> DataFrame:
    return m.entities.where("CAST(substr(id, 2) AS BIGINT) % 50 = 0").select(F.col("id").alias("query_id"), "kind", F.col("canonical_name").alias("name"))


def resolve_actions(m: Memory) -> DataFrame:
    """What becomes of the names whose number is divisible by 50, with the band of their best score."""
    asked = asked_names(m)
    found = store.durable(resolve.resolve_batch(asked, entities(m)), "resolved")
    scores = m.spark.createDataFrame([], "query_id string, entity_id string, verified double")
    out = resolve.resolve_or_create(asked, found, scores)
    best = found.groupBy("query_id").agg(F.max("trgm_score").alias("best"))
    return out.join(best, "query_id", "left").select("query_id", "action", "entity_id", "adds_alias", resolve.recommendation(F.coalesce("best", F.lit(0.0))).alias("recommendation"))


def hybrid_fulltext_topk(m: Memory) -> DataFrame:
    """The flagship with the English full-text channel: stems, a web query and cover density, over all experiences."""
    out = search.hybrid(m.experiences, CONTENT, vector(m), 10, lexical=lexical_channel)
    return out.select("id", *(c.alias(n) for n, c in r6("vec_score", "lex_score", "fused_score").items()))


def recall_fulltext(m: Memory) -> DataFrame:
    out = search.recall_recent(m.experiences, now(EARLY), 2, query=CONTENT, embedding=vector(m), limit=20, lexical=lexical_channel)
    return out.select("id", *(c.alias(n) for n, c in r6("vec_score", "lex_score", "fused_score").items()))


_BATCH = O.SQL["resolve_batch_topk"]
_INDEX = O.SQL["claim_binding_index"]
_ALIASES = "coalesce(alias1, '')"

SQL = {
    "merge_two": f"""
SELECT id, canonical_name, CASE WHEN id = 's1' THEN (SELECT canonical_name FROM v_entities WHERE id = 's2') ELSE {_ALIASES} END AS aliases, CASE WHEN id = 's2' THEN 's1' ELSE merged_into END AS merged_into FROM v_entities""",
    "unmerge_one": """
SELECT id, CASE WHEN id <> (SELECT arg_min(id, CAST(substr(id, 2) AS BIGINT)) FROM v_entities WHERE merged_into IS NOT NULL) THEN merged_into END AS merged_into FROM v_entities""",
    "rename_one": f"""
SELECT id, CASE WHEN id = 's1' THEN 'Renamed' ELSE canonical_name END AS canonical_name, CASE WHEN id = 's1' THEN canonical_name ELSE {_ALIASES} END AS aliases, merged_into FROM v_entities""",
    "append_alias_one": f"SELECT id, canonical_name, CASE WHEN id = 'c1' THEN alias1 || '|also' ELSE {_ALIASES} END AS aliases, merged_into FROM v_entities",
    "retract_one": "SELECT id, CASE WHEN id = (SELECT min(id) FROM v_claims WHERE polarity <> 'retracted') THEN 'retracted' ELSE polarity END AS polarity FROM v_claims",
    "delete_one": f"""
SELECT id, CASE WHEN id IN (SELECT s.claim_id FROM v_claim_sources s JOIN v_experiences e ON e.id = s.experience_id WHERE e.id = 1 AND e.deleted_at IS NULL)
  AND id NOT IN (SELECT s.claim_id FROM v_claim_sources s JOIN v_experiences e ON e.id = s.experience_id WHERE e.id <> 1 AND {O.LIVE}) THEN 'retracted' ELSE polarity END AS polarity FROM v_claims""",
    "share_one": "SELECT id, CASE WHEN id = 1 THEN 'shared' ELSE visibility END AS visibility FROM v_experiences",
    "patch_one": "SELECT id, CASE WHEN id = 2 THEN 'derived' ELSE source_kind END AS source_kind, CASE WHEN id = 2 THEN 'somebody' ELSE owner END AS owner FROM v_experiences",
    "split_one": """
WITH w AS (SELECT arg_min(entity_id, experience_id) AS id FROM v_mentions WHERE field = 'people')
SELECT DISTINCT experience_id, CASE WHEN entity_id = (SELECT id FROM w) AND experience_id % 2 = 0 AND experience_id IN (SELECT id FROM v_experiences) THEN 'new' ELSE entity_id END AS entity_id, surface_form, field FROM v_mentions""",
    "split_claims_one": """
WITH w AS (SELECT arg_min(c.subject_id, s.experience_id) AS who, min(s.experience_id) AS x FROM v_claims c JOIN v_claim_sources s ON s.claim_id = c.id),
t AS (SELECT claim_id FROM v_claim_sources WHERE experience_id = (SELECT x FROM w))
SELECT id, CASE WHEN id IN (SELECT claim_id FROM t) AND subject_id = (SELECT who FROM w) THEN 'new' ELSE subject_id END AS subject_id, object_entity_id FROM v_claims""",
    "chain_flatten": """
SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN 'p' || (p_partkey - p_partkey % 10) END AS merged_into, p_partkey % 10 > 1 AS moved FROM part""",
    "chain_ends": "SELECT 'p' || p_partkey AS id, 'p' || (p_partkey - p_partkey % 10) AS terminal, CAST(p_partkey % 10 AS BIGINT) AS hops FROM part WHERE p_partkey % 10 <> 0",
    "claims_bound": f"""
WITH idx AS ({_INDEX}), c AS (SELECT DISTINCT p.experience_id, p.surface_form AS subject, t.surface_form AS object FROM v_mentions p JOIN v_mentions t ON t.experience_id = p.experience_id WHERE p.field = 'people' AND t.field = 'topics')
SELECT c.experience_id, s.entity_id AS subject_id, c.object, o.entity_id AS object_entity_id, CASE WHEN o.entity_id IS NULL THEN c.object END AS object_literal
FROM c LEFT JOIN idx s ON s.kind = 'person' AND s.norm = {O.FOLD.format(x='c.subject')} LEFT JOIN idx o ON o.kind = 'concept' AND o.norm = {O.FOLD.format(x='c.object')}""",
    "entity_usage": """
SELECT (SELECT count(*) FROM v_claims WHERE subject_id = 'p7' OR object_entity_id = 'p7') AS claim_count, (SELECT count(*) FROM v_mentions WHERE entity_id = 'p7') AS mention_count,
  (SELECT coalesce(string_agg(DISTINCT surface_form, '|' ORDER BY surface_form), '') FROM v_mentions WHERE entity_id = 'p7') AS surface_forms""",
    "merge_evidence": f"""
WITH {O.CANDIDATES}, ends AS (SELECT entity_a AS id FROM cand UNION SELECT entity_b FROM cand),
r AS (SELECT m.entity_id, m.experience_id, e.content, row_number() OVER (PARTITION BY m.entity_id ORDER BY e.captured_at DESC, m.experience_id) AS k
  FROM (SELECT DISTINCT entity_id, experience_id FROM v_mentions WHERE entity_id IN (SELECT id FROM ends)) m JOIN v_experiences e ON e.id = m.experience_id)
SELECT entity_id, experience_id, {O.snippet('content', 120)} AS snippet, k FROM r WHERE k <= 2""",
    "merge_queue_shown": f"""
WITH {O.CANDIDATES}, cnt AS (SELECT coalesce(n.merged_into, n.id) AS s, count(DISTINCT m.experience_id) AS n FROM v_mentions m JOIN v_entities n ON n.id = m.entity_id GROUP BY 1),
touched AS (SELECT DISTINCT e FROM (SELECT subject_id AS e FROM v_claims WHERE polarity <> 'retracted' UNION ALL SELECT object_entity_id FROM v_claims WHERE polarity <> 'retracted') WHERE e IS NOT NULL)
SELECT c.id, c.entity_a, a.canonical_name AS name_a, c.entity_b, b.canonical_name AS name_b FROM cand c JOIN v_entities a ON a.id = c.entity_a JOIN v_entities b ON b.id = c.entity_b
LEFT JOIN cnt ca ON ca.s = coalesce(a.merged_into, a.id) LEFT JOIN cnt cb ON cb.s = coalesce(b.merged_into, b.id)
WHERE c.status = 'pending' AND NOT (c.entity_a NOT IN (SELECT e FROM touched) AND c.entity_b NOT IN (SELECT e FROM touched) AND coalesce(ca.n, 0) <= 1 AND coalesce(cb.n, 0) <= 1) ORDER BY c.id LIMIT 200""",
    "experience_claims": "SELECT c.id AS claim_id, s.support_kind, c.predicate, n.canonical_name AS object_name FROM v_claim_sources s JOIN v_claims c ON c.id = s.claim_id LEFT JOIN v_entities n ON n.id = c.object_entity_id WHERE s.experience_id = 1",
    "entity_claims": "SELECT c.id, c.predicate, (SELECT count(*) FROM v_claim_sources s WHERE s.claim_id = c.id) AS source_count FROM v_claims c WHERE c.subject_id = 'c1'",
    "feed_second_page": f"SELECT id, captured_at FROM v_experiences WHERE {O.LIVE} ORDER BY captured_at DESC, id LIMIT 20 OFFSET 20",
    "mentions_counted": """
SELECT experience_id, (SELECT count(*) FROM v_mentions WHERE entity_id = 'p7') AS total, (SELECT count(*) FROM v_mentions WHERE entity_id = 'p7') > 4 AS more FROM v_mentions WHERE entity_id = 'p7' ORDER BY experience_id, surface_form LIMIT 3 OFFSET 1""",
    "paraphrased_claims": "SELECT DISTINCT s.experience_id, s.claim_id, s.support_kind FROM v_claim_sources s JOIN v_claims c ON c.id = s.claim_id JOIN v_experiences e ON e.id = s.experience_id WHERE s.support_kind = 'paraphrased' AND c.polarity = 'asserted'",
    "thoughts_view": "SELECT id, captured_at AS created_at, content FROM v_experiences",
    "canonical_pair_rows": f"WITH {O.CANDIDATES} SELECT DISTINCT entity_a, entity_b FROM cand",
    "upsert_coalesced": """
SELECT coalesce(p.k, s.k) AS k, coalesce(p.name, s.name) AS name FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name FROM part) p
FULL JOIN (SELECT s_suppkey * 40 AS k, s_name AS name FROM supplier) s ON s.k = p.k""",
    "inserted_if_absent": "SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 <> 0",
    "snapshot_manifest": """
SELECT 'experiences' AS "table", count(*) AS rows FROM v_experiences UNION ALL SELECT 'entities', count(*) FROM v_entities UNION ALL SELECT 'claims', count(*) FROM v_claims UNION ALL SELECT 'mentions', count(*) FROM v_mentions""",
    "field_formats": """
SELECT id, strftime(captured_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, owner || '/' || sha256(content) || '.webp' AS key,
  round((id % 90 + 1 + (id % 60) / 60.0::DOUBLE + (id % 7) / 3600.0::DOUBLE) * CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END, 6) AS degrees, owner IS NOT DISTINCT FROM '3' AS mine FROM v_experiences""",
    "name_parts": f"""
WITH f AS (SELECT id, string_split({O.FOLD.format(x='canonical_name')}, ' ') AS w FROM v_entities)
SELECT id, array_to_string(w, ' ') AS core, CAST(len(w) AS BIGINT) AS n, '' AS suffix, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))), ' ') AS numbers FROM f""",
    "resolve_actions": f"""
WITH b AS ({_BATCH}), best AS (SELECT query_id, arg_min(entity_id, rank) AS entity_id, max(trgm_score) AS s FROM b GROUP BY 1),
q AS (SELECT id AS query_id FROM v_entities WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0)
SELECT q.query_id, CASE WHEN s > 0.85 THEN 'matched' WHEN s > 0.55 THEN 'provisional' ELSE 'created' END AS action, CASE WHEN s > 0.55 THEN entity_id END AS entity_id, coalesce(s > 0.85, FALSE) AS adds_alias,
  CASE WHEN s > 0.85 THEN 'reuse' WHEN s > 0.55 THEN 'disambiguate' ELSE 'create' END AS recommendation FROM q LEFT JOIN best ON best.query_id = q.query_id""",
}

MADE = [
    merge_two, unmerge_one, rename_one, append_alias_one, retract_one, delete_one, share_one, patch_one, split_one, split_claims_one, chain_flatten, chain_ends, claims_bound, entity_usage, merge_evidence,
    merge_queue_shown, experience_claims, entity_claims, feed_second_page, mentions_counted, paraphrased_claims, thoughts_view, canonical_pair_rows, upsert_coalesced, inserted_if_absent, snapshot_manifest,
    field_formats, name_parts, resolve_actions, hybrid_fulltext_topk, recall_fulltext,
]
