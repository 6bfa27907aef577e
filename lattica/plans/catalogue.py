"""The engine's registered queries over the projections of :mod:`lattica.sources.views`, and their SQL equivalents.

Ties are broken by id everywhere, scores are rounded to six places, and the present is ``AS_OF``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.functions.names import jaro_winkler_udf
from lattica.operators import aggregates, dedup, graph, lifecycle, listings, resolve, review, search
from lattica.plans import changes
from lattica.plans.base import EARLY, SEED, WORDS, entities, merge_candidates, now, r6, vector
from lattica.plans.oracles import SQL
from lattica.session import configure
from lattica.sources.durable import orphan_keys
from lattica.sources.views import Memory, oracle
from lattica.streaming import consolidation, salience

#: The query that ``entry`` runs.
FLAGSHIP = "hybrid_rrf_topk"
def audit_events(m: Memory) -> DataFrame:
    """An audit log made of events: each type stands for a kind of change."""
    t, n = F.col("event_type"), F.col("event_id").cast("string")
    return m.spark.table("events").select(
        F.col("event_id").alias("id"),
        F.when(t == "purchase", "claim").when(t.isin("view", "click"), "entity").otherwise("experience").alias("target_kind"),
        F.when(t.isin("view", "click"), F.concat(F.lit("c"), (F.col("event_id") % 100 + 1).cast("string"))).otherwise(n).alias("target_id"),
        F.when(t == "click", F.lit('{"merged_into": null, "canonical_name": "x"}')).when(t == "view", '{"canonical_name": "x"}').when(t == "error", '{"deleted_at": null}').otherwise('{"visibility": "private"}').alias("before"),
        F.when(t == "click", F.lit('{"merged_into": "c1", "canonical_name": "y"}')).when(t == "view", '{"canonical_name": "y"}').when(t == "error", '{"deleted_at": "now"}').otherwise('{"visibility": "shared"}').alias("after"),
        F.when(F.col("event_id") % 3 == 0, "ui-session:1").when(F.col("event_id") % 3 == 1, "consolidation").otherwise("backfill").alias("created_by"),
        F.col("ts").alias("created_at"),
    )


def work_queue(m: Memory) -> DataFrame:
    minutes = (F.col("event_id") % 60).cast("int")
    return m.spark.table("events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 4 == 0, "in_progress").when(F.col("event_id") % 4 == 3, "complete").otherwise("pending").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempts"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(now() - F.make_dt_interval(mins=minutes)).alias("attempted_at"),
        F.col("ts").alias("captured_at"),
    )


def hybrid_rrf_topk(m: Memory) -> DataFrame:
    out = search.hybrid(m.experiences, WORDS, vector(m), 10)
    return out.select("id", *(c.alias(n) for n, c in r6("vec_score", "lex_score", "fused_score").items()))


def vector_topk(m: Memory) -> DataFrame:
    out = search.vector_channel(search.candidates(m.experiences), vector(m), 20)
    return out.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_batch_topk(m: Memory) -> DataFrame:
    """As many queries as the table gives: every row whose id is divisible by 50."""
    queries = m.spark.table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.vector_batch(m.experiences, queries, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def legacy_threshold_search(m: Memory) -> DataFrame:
    return search.by_similarity(m.experiences, vector(m), 0.1, 50).select("id", F.round("similarity", 6).alias("similarity"))


def list_filtered(m: Memory) -> DataFrame:
    out = listings.list_thoughts(m.experiences.withColumn("metadata", F.to_json(F.struct(F.col("meta_type").alias("type"), F.array("meta_topic1", "meta_topic2").alias("topics")))), now(), viewer="3", type="view", topic="en", days=30, limit=50)
    return out.select("id", "created_at")


def recent_feed(m: Memory) -> DataFrame:
    out = listings.recent_feed(m.experiences, m.mentions, m.entities, limit=20)
    return out.select("id", "snippet", "captured_at", "visibility", "lat", "lng", F.array_join(F.transform("entities", lambda e: e["name"]), "|").alias("names"))


def day_buckets(m: Memory) -> DataFrame:
    return listings.day_buckets(m.experiences, now(EARLY)).groupBy("bucket", "bucket_order").agg(F.count("*").alias("n"))


def recall_window(m: Memory) -> DataFrame:
    return search.recall_recent(m.experiences, now(EARLY), 2, viewer="3", source_kind="derived", limit=20).select("id", "captured_at", "fused_score")


def who_was_at_date(m: Memory) -> DataFrame:
    return graph.who_was_at(m.experiences, m.mentions, m.entities, day=F.lit("2024-01-01").cast("date")).select("entity_id", "canonical_name", "kind", "surface_form")


def who_was_at_experience(m: Memory) -> DataFrame:
    return graph.who_was_at(m.experiences, m.mentions, m.entities, experience_id=1).select("entity_id", "canonical_name", "kind", "surface_form")


def entity_timeline(m: Memory) -> DataFrame:
    return listings.entity_timeline(m.experiences, m.mentions, "p7").select("id", "captured_at", "occurred_at", "surface_form")


def entity_mention_counts(m: Memory) -> DataFrame:
    return aggregates.mention_counts(m.mentions, m.experiences, "3")


def recently_active(m: Memory) -> DataFrame:
    out = aggregates.recently_active(m.mentions, m.experiences, m.entities, now())
    return listings.with_recency(out, "last_seen", now())


def summary_counts(m: Memory) -> DataFrame:
    return aggregates.summary(m.experiences, m.entities, m.claims)


def top_entities(m: Memory) -> DataFrame:
    return aggregates.top_entities(m.mentions, m.entities)


def top_topics(m: Memory) -> DataFrame:
    return aggregates.top_topics(m.experiences, F.array("meta_topic1", "meta_topic2"))


def type_histogram(m: Memory) -> DataFrame:
    return aggregates.histogram(m.experiences, "meta_type", "3")


def pending_review_counts(m: Memory) -> DataFrame:
    none = m.spark.createDataFrame([], "id long, status string")
    return review.pending_counts(merge_candidates(m), m.claims, m.claim_sources, none, none)


def low_confidence_queue(m: Memory) -> DataFrame:
    return review.low_confidence_queue(m.claims, m.claim_sources).select("claim_id", "experience_id", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


def contradictions(m: Memory) -> DataFrame:
    return review.contradictions(m.claims).select("id", "subject_id", "predicate", "superseded_by")


def split_candidates(m: Memory) -> DataFrame:
    return graph.split_candidates(m.claims, m.entities)


def impact_gate_deferred(m: Memory) -> DataFrame:
    return review.low_impact(merge_candidates(m), m.entities, m.claims, m.mentions).select("id", "deferred")


def provenance_block(m: Memory) -> DataFrame:
    """The claims of every experience."""
    block = search.provenance_block(search.provenance(m.claims, m.claim_sources, m.experiences.select("id"), 0.6))
    return block.select("experience_id", F.array_join(F.transform("provenance", lambda c: c["claim_id"].cast("string")), ",").alias("claims"))


def salience_decay(m: Memory) -> DataFrame:
    targets = m.spark.table("events").select(F.col("user_id").alias("id")).distinct()
    return aggregates.salience(targets, m.recall_events, "experience", now()).select("id", F.round(F.col("salience").cast("double"), 4).alias("salience"))


def salience_from_windows(m: Memory) -> DataFrame:
    return salience.from_windows(salience.windowed(m.recall_events), now()).select("target_kind", "target_id", F.round("salience", 6).alias("salience"))


def relationships_2hop(m: Memory) -> DataFrame:
    return graph.relationships_to(m.claims, m.entities, SEED, 2, 0.6).withColumns(r6("confidence")).withColumn("hops", F.col("hops").cast("long"))


def relationships_3hop(m: Memory) -> DataFrame:
    return graph.relationships_to(m.claims, m.entities, SEED, 3, 0.6).select(F.col("hops").cast("long").alias("hops"), "confidence").groupBy("hops").agg(F.count("*").alias("n"), F.round(F.max("confidence").cast("double"), 6).alias("best"))


def survivor_flatten(m: Memory) -> DataFrame:
    return graph.flatten_chains(m.entities).select("id", "terminal", "hops")


def mention_ids_by_name(m: Memory) -> DataFrame:
    name = m.spark.table("part").where("p_partkey = 1").select("p_name").first()[0]
    return graph.experience_ids_mentioning(name, entities(m), m.mentions, "concept")


def bbox_contiguous(m: Memory) -> DataFrame:
    return listings.in_box(m.experiences, (-30.0, -60.0, 45.0, 80.0)).select("id", "lat", "lng")


def bbox_antimeridian(m: Memory) -> DataFrame:
    return listings.in_box(m.experiences, (-90.0, 120.0, 90.0, -120.0)).select("id", "lat", "lng")


def activity_typed(m: Memory) -> DataFrame:
    return review.activity(audit_events(m), m.experiences, m.entities, m.claims, 200).select("id", "change_type", "actor", "entity_name", "winner_name", "claim_predicate")


def orphan_claims(m: Memory) -> DataFrame:
    gone = m.experiences.where("deleted_at IS NOT NULL").select("id")
    return lifecycle.orphan_claims(m.claims, m.claim_sources, m.experiences, gone).select("id")


def claim_binding_index(m: Memory) -> DataFrame:
    return resolve.binding_index(m.mentions, m.entities)


def token_blocks(m: Memory) -> DataFrame:
    """Token blocking over all unmerged entities: each block with its members, which stand for its pairs."""
    return dedup.blocks(dedup.token_keys(dedup.named(entities(m)))).select("key", "id", F.col("size").cast("long").alias("size"))


def exact_dup_merge_plan(m: Memory) -> DataFrame:
    """The merges that the default plan makes of all unmerged entities."""
    return dedup.plan(entities(m)).where("action = 'merge'").select("loser", "winner", "score")


def dedup_plan(m: Memory) -> DataFrame:
    """The operator's default plan, merges and queue, over all unmerged entities."""
    return dedup.plan(entities(m)).select("action", "loser", "winner", "score")


def minhash_blocking_pairs(m: Memory) -> DataFrame:
    """The bands of all unmerged entities with their members: the candidate pairs are the pairs within a band."""
    return dedup.blocks(dedup.minhash_keys(dedup.named(entities(m))))


def contested_entities(m: Memory) -> DataFrame:
    return dedup.contested(merge_candidates(m).where("status = 'pending'").select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b")))


def held_pairs(m: Memory) -> DataFrame:
    return dedup.held_pairs(merge_candidates(m), m.entities)


def trigram_similarity_topk(m: Memory) -> DataFrame:
    name = m.spark.table("part").where("p_partkey = 2").select("p_name").first()[0]
    out = resolve.trigram_channel(resolve.canonical(entities(m), "concept"), name)
    return out.select("id", F.round(F.col("score").cast("double"), 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def resolve_batch_topk(m: Memory) -> DataFrame:
    """The names of the entities of every kind whose number is divisible by 50, against all entities."""
    asked = m.entities.where("CAST(substr(id, 2) AS BIGINT) % 50 = 0").select(F.col("id").alias("query_id"), "kind", F.col("canonical_name").alias("name"))
    return resolve.resolve_batch(asked, entities(m)).select("query_id", "entity_id", F.round(F.col("trgm_score").cast("double"), 5).alias("trgm_score"), F.col("rank").cast("long").alias("rank"))


def resolve_entity_ranked(m: Memory) -> DataFrame:
    name = m.spark.table("part").where("p_partkey = 2").select("p_name").first()[0]
    return resolve.resolve_entity(entities(m), name, "concept").withColumns(r6("trgm_score", "fused_score"))


def jaro_winkler_pairs(m: Memory) -> DataFrame:
    """The distinct names of parts, nations, regions and market segments, each with those of the same two first letters."""
    columns = {"part": "p_name", "nation": "n_name", "region": "r_name", "customer": "c_mktsegment"}
    names = reduce(DataFrame.union, [m.spark.table(t).select(F.col(c).alias("x")) for t, c in columns.items()]).distinct()
    pairs = names.select("x", F.substring("x", 1, 2).alias("k")).join(names.select(F.col("x").alias("y"), F.substring("x", 1, 2).alias("k")), "k").where("x < y")
    return pairs.select("x", "y", F.round(jaro_winkler_udf("x", "y"), 6).alias("similarity"))


def fs_match_probability(m: Memory) -> DataFrame:
    """The candidate pairs of all unmerged entities that the probabilistic scorer can bring to a review."""
    rows = dedup.named(entities(m))
    keys = dedup.token_keys(rows).distinct()
    shared = dedup.shared_forms(rows).where("kind <> 'person'").join(keys, "id")
    pairs = dedup.telling_pairs(keys, rows).union(dedup.ordered(shared, shared, ["kind", "form", "key"])).distinct()
    return dedup.scored_pairs(pairs, rows, "fs").select("a", "b", F.round("score", 6).alias("score"))


def id_set_intersection(m: Memory) -> DataFrame:
    a, b = (m.mentions.where(F.col("field") == f).select(F.col("experience_id").alias("id")).distinct() for f in ("people", "topics"))
    return a.join(b, "id", "left_semi")


def orphan_keys_anti(m: Memory) -> DataFrame:
    store = m.spark.table("orders").select(F.col("o_orderkey").alias("object_key"))
    return orphan_keys(store, m.spark.table("documents").select(F.col("doc_id").alias("object_key")))


def retry_eligibility(m: Memory) -> DataFrame:
    queue = consolidation.reclaimed(work_queue(m), now())
    return queue.select("id", "status", F.col("attempts").cast("long").alias("attempts"), consolidation.due(queue, now()).alias("due"))


def retry_pick(m: Memory) -> DataFrame:
    return consolidation.picked(consolidation.reclaimed(work_queue(m), now()), now())


def edit_decision(m: Memory) -> DataFrame:
    other = m.experiences.select((F.col("id") - 1).alias("id"), F.lit("new").alias("new_content"), F.col("embedding").alias("new_embedding"))
    return lifecycle.edit_decisions(other, m.experiences).withColumns(r6("similarity"))


def excerpt_snippet(m: Memory) -> DataFrame:
    return m.experiences.select("id", X.snippet(F.col("content"), 280).alias("snippet"), X.excerpt(F.col("content"), "the", 200).alias("excerpt"))


def claim_source_counts(m: Memory) -> DataFrame:
    counts = m.claim_sources.groupBy(F.col("claim_id").alias("id")).agg(F.count("*").alias("source_count"))
    per = m.claim_sources.groupBy("experience_id").agg(F.count("*").alias("claim_count"))
    return m.claims.join(counts, "id").join(m.claim_sources.select(F.col("claim_id").alias("id"), "experience_id"), "id").join(per, "experience_id").select("id", "source_count", "claim_count")


def top_people_first_seen(m: Memory) -> DataFrame:
    seen = m.mentions.where("field = 'people'").join(m.experiences.select(F.col("id").alias("experience_id"), "captured_at"), "experience_id")
    return aggregates.top_in_first_seen_order(seen, "surface_form", [-F.unix_micros(F.col("captured_at").cast("timestamp")), F.col("experience_id")])


def person_topic_search(m: Memory) -> DataFrame:
    """Experiences that mention a topic by name, by closeness to a vector."""
    name = m.spark.table("part").where("p_partkey = 1").select("p_name").first()[0]
    ids = graph.experience_ids_mentioning(name, entities(m), m.mentions, "concept")
    return search.vector_channel(search.candidates(m.experiences, ids=ids), vector(m), 20).select("id", F.round("score", 6).alias("score"))


MADE: list[Callable[[Memory], DataFrame]] = [
    hybrid_rrf_topk, vector_topk, vector_batch_topk, legacy_threshold_search, list_filtered, recent_feed, day_buckets, recall_window, who_was_at_date, who_was_at_experience, entity_timeline,
    entity_mention_counts, recently_active, summary_counts, top_entities, top_topics, type_histogram, pending_review_counts, low_confidence_queue, contradictions, split_candidates,
    impact_gate_deferred, provenance_block, salience_decay, salience_from_windows, relationships_2hop, relationships_3hop, survivor_flatten, mention_ids_by_name, bbox_contiguous,
    bbox_antimeridian, activity_typed, orphan_claims, claim_binding_index, token_blocks, exact_dup_merge_plan, dedup_plan, minhash_blocking_pairs, contested_entities, held_pairs,
    trigram_similarity_topk, resolve_batch_topk, resolve_entity_ranked, jaro_winkler_pairs, fs_match_probability, id_set_intersection, orphan_keys_anti, retry_eligibility, retry_pick,
    edit_decision, excerpt_snippet, claim_source_counts, top_people_first_seen, person_topic_search,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: lambda spark, sf_dir, f=f: f(Memory(configure(spark), sf_dir)) for f in [*MADE, *changes.MADE]}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in (SQL | changes.SQL).items()}
