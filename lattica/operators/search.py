"""Hybrid retrieval: a vector and a lexical channel over live, visible experiences, fused by rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.predicates import all_of, contains, live, since, visible
from lattica.functions.text import words
from lattica.functions.vector import distance_to
from lattica.operators.blocked import best_of_blocks, cosines
from lattica.operators.fusion import CHANNEL, fuse, top_ranked

HIT = ["id", "content", "metadata", "captured_at", "occurred_at"]


def candidates(experiences: DataFrame, viewer: str | None = None, ids: DataFrame | None = None, filter: dict | None = None) -> DataFrame:
    """Live and visible, within an allowlist (a frame of ids) and containing ``filter`` in their metadata."""
    df = experiences.where(live() & visible(viewer))
    if ids is not None:
        df = df.join(ids.select("id").distinct(), "id", "left_semi")
    return df.where(contains("metadata", filter)) if filter else df


def vector_channel(df: DataFrame, embedding: Sequence[float] | None, n: int = CHANNEL) -> DataFrame:
    """The nearest by cosine among those on the query's side; empty without an embedding."""
    if embedding is None:
        return df.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    scored = df.where(F.col("embedding").isNotNull()).select("id", (1 - distance_to(F.col("embedding"), embedding)).alias("score")).where(F.col("score") > 0)
    return top_ranked(scored, F.col("score"), "id", n)


def token_channel(df: DataFrame, query: str, n: int = CHANNEL) -> DataFrame:
    """Plain tokens: texts that hold all of the query's words, by the words' share of the text."""
    terms = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    if not terms:
        return df.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    tokens = df.where(all_of([F.lower("content").contains(t) for t in terms])).select("id", words(F.col("content")).alias("w"))
    count = lambda term: F.size(F.filter("w", lambda x: x == term))
    hits = sum((count(t) for t in terms), F.lit(0))
    full = all_of([F.array_contains("w", t) for t in terms])
    return top_ranked(tokens.where(full).select("id", (hits / F.size("w")).alias("score")), F.col("score"), "id", n)


def hybrid(
    experiences: DataFrame, query: str, embedding: Sequence[float] | None, limit: int = 10, filter: dict | None = None, threshold: float = 0.0,
    ids: DataFrame | None = None, viewer: str | None = None, lexical: Callable[[DataFrame, str], DataFrame] = token_channel,
) -> DataFrame:
    """id, content, metadata, captured_at, occurred_at, vec_score, lex_score, fused_score; best first."""
    pool = candidates(experiences, viewer, ids, filter)
    fused = fuse({"vec_score": vector_channel(pool, embedding), "lex_score": lexical(pool, query)}, "id").where(F.col("fused_score") >= threshold)
    best = fused.orderBy(F.desc("fused_score"), F.desc("vec_score"), F.desc("lex_score"), "id").limit(limit)
    return pool.select(*HIT).join(best, "id").orderBy(F.desc("fused_score"), F.desc("vec_score"), F.desc("lex_score"), "id")


def vector_batch(experiences: DataFrame, queries: DataFrame, n: int = 10, viewer: str | None = None) -> DataFrame:
    """query_id, id, score, rank for many queries (query_id, embedding) at once, each with the nearest on its side."""
    pool = candidates(experiences, viewer).where(F.col("embedding").isNotNull()).select("id", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("q"))
    return best_of_blocks(pool, asked, cosines, n, 0.0)


def by_similarity(experiences: DataFrame, embedding: Sequence[float], threshold: float, limit: int, filter: dict | None = None) -> DataFrame:
    """The plain threshold search; it looks at all rows, live or not."""
    similarity = 1 - distance_to(F.col("embedding"), embedding)
    df = experiences.where(contains("metadata", filter)) if filter else experiences
    return df.select("id", "content", "metadata", similarity.alias("similarity"), F.col("captured_at").alias("created_at")).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(limit)


def recall_recent(experiences: DataFrame, now: Column, days: int = 7, viewer: str | None = None, source_kind: str | None = None, query: str | None = None, embedding: Sequence[float] | None = None, limit: int = 20, window: int = 500, lexical: Callable[[DataFrame, str], DataFrame] = token_channel) -> DataFrame:
    """The newest of a window of days, or the best of the window's newest 500 for a query."""
    if days <= 0:
        raise ValueError("days must be positive")
    df = experiences.where(since("captured_at", now, days) & visible(viewer))
    df = df.where(F.col("source_kind") == source_kind) if source_kind else df
    newest = df.orderBy(F.desc("captured_at"), "id")
    if query:
        return hybrid(experiences, query, embedding, limit, ids=newest.limit(window).select("id"), viewer=viewer, lexical=lexical)
    zero = [F.lit(0.0).alias(c) for c in ("vec_score", "lex_score", "fused_score")]
    return newest.limit(min(limit, window)).select(*HIT, *zero)


def provenance(claims: DataFrame, sources: DataFrame, hits: DataFrame, min_confidence: float | None = None, retracted: bool = False) -> DataFrame:
    """Claims by the experiences in ``hits`` (id); claims without a confidence stay whatever the floor."""
    df = claims.where(F.col("polarity") != "retracted") if not retracted else claims
    if min_confidence is not None:
        df = df.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    links = sources.join(hits.select(F.col("id").alias("experience_id")).distinct(), "experience_id", "left_semi")
    return links.join(df, links.claim_id == df.id).select("experience_id", "claim_id", "predicate", "object_literal", "polarity", "confidence", "support_kind", df.superseded_by, "created_at")


def provenance_block(rows: DataFrame) -> DataFrame:
    """One array of claims for each experience: highest confidence first, unknown ones last, then oldest."""
    fields = [c for c in rows.columns if c != "experience_id"]
    key = [F.col("confidence").isNull().alias("k0"), (-F.col("confidence")).alias("k1"), F.col("created_at").alias("k2"), F.col("claim_id").alias("k3")]
    packed = F.sort_array(F.collect_list(F.struct(*key, F.struct(*fields).alias("claim"))))
    return rows.groupBy("experience_id").agg(F.transform(packed, lambda x: x["claim"]).alias("provenance"))


def tagged(hits: DataFrame, mentions: DataFrame, entities: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``hits`` with entities (unmerged ones that are mentioned, by name) and, with ``sources``, claim_count."""
    here = mentions.join(hits.select(F.col("id").alias("experience_id")).distinct(), "experience_id", "left_semi")
    alive = entities.where(F.col("merged_into").isNull()).select(F.col("id").alias("entity_id"), "canonical_name", "kind")
    named = here.select("experience_id", "entity_id").distinct().join(alive, "entity_id")
    lists = named.groupBy(F.col("experience_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("canonical_name").alias("name"), "kind", "entity_id"))).alias("entities"))
    out = hits.join(lists, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(lists.schema["entities"].dataType)))
    if sources is not None:
        counts = sources.join(hits.select(F.col("id").alias("experience_id")).distinct(), "experience_id", "left_semi").groupBy(F.col("experience_id").alias("id")).agg(F.count("*").alias("claim_count"))
        out = out.join(counts, "id", "left").withColumn("claim_count", F.coalesce("claim_count", F.lit(0)))
    return out

