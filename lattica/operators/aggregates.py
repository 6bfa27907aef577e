"""Counts, histograms, summaries and decayed salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.predicates import live, since, visible

#: Of the salience of a target.
SALIENCE_DAYS, SALIENCE_SCALE_DAYS = 180, 30
OUTCOMES = {"helpful": 1.0, "wrong": -0.5}


def summary(experiences: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """One row; three single aggregations side by side."""
    e = experiences.where(live()).agg(F.count("*").alias("experience_count"), F.min("captured_at").alias("earliest"), F.max("captured_at").alias("latest"))
    n = entities.where(F.col("merged_into").isNull()).agg(F.count("*").alias("entity_count"))
    c = claims.where(F.col("polarity") != "retracted").agg(F.count("*").alias("claim_count"))
    return e.join(n).join(c)


def top_entities(mentions: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """By mention rows of unmerged entities; rows of merged ones count for nobody."""
    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mention_count"))
    alive = entities.where(F.col("merged_into").isNull()).select("id", "canonical_name", "kind")
    return counts.join(alive, "id").orderBy(F.desc("mention_count"), "canonical_name", "id").limit(limit)


def top_topics(experiences: DataFrame, topics: Column, limit: int = 10) -> DataFrame:
    """``topics``: array of strings, null for none."""
    return experiences.where(live()).select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "topic").limit(limit)


def histogram(experiences: DataFrame, by: str, viewer: str | None = None) -> DataFrame:
    return experiences.where(visible(viewer)).groupBy(F.col(by).alias("type")).agg(F.count("*").alias("count"))


def top_in_first_seen_order(rows: DataFrame, value: str, order: list[Column], limit: int = 10) -> DataFrame:
    """The most frequent values; of equally frequent ones the one met first in ``order``."""
    counted = rows.groupBy(F.col(value).alias("name")).agg(F.count("*").alias("count"), F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("first"))
    return counted.orderBy(F.desc("count"), "first", "name").limit(limit).select("name", "count")


def mention_counts(mentions: DataFrame, experiences: DataFrame, viewer: str | None = None) -> DataFrame:
    """Distinct live and visible experiences for each stored entity."""
    seen = experiences.where(live() & visible(viewer)).select(F.col("id").alias("experience_id"))
    return mentions.join(seen, "experience_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("experience_id").alias("mention_count"))


def survivor_mention_counts(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    dim = entities.select(F.col("id").alias("entity_id"), F.coalesce("merged_into", "id").alias("survivor"))
    return mentions.join(dim, "entity_id").groupBy("survivor").agg(F.countDistinct("experience_id").alias("n"))


def recently_active(mentions: DataFrame, experiences: DataFrame, entities: DataFrame, now: Column, days: int = 30, viewer: str | None = None, limit: int = 20) -> DataFrame:
    """Unmerged entities by their latest live and visible experience of the window."""
    seen = experiences.where(live() & visible(viewer) & since("captured_at", now, days, strict=True)).select(F.col("id").alias("experience_id"), "captured_at")
    last = mentions.join(seen, "experience_id").groupBy(F.col("entity_id").alias("id")).agg(F.max("captured_at").alias("last_seen"))
    alive = entities.where(F.col("merged_into").isNull()).select("id", "canonical_name", "kind")
    return last.join(alive, "id").orderBy(F.desc("last_seen"), "id").limit(limit)


def salience(targets: DataFrame, events: DataFrame, kind: str, now: Column) -> DataFrame:
    """(id, salience) of every target: recalls of the window, weighted by outcome and decayed by age; others 0."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("recalled_at").cast("timestamp"))) / 1e6
    weight = F.when(F.col("outcome") == "helpful", OUTCOMES["helpful"]).when(F.col("outcome") == "wrong", OUTCOMES["wrong"]).otherwise(0.0)
    recent = events.where((F.col("target_kind") == kind) & (F.col("recalled_at") > now - F.make_dt_interval(F.lit(SALIENCE_DAYS))))
    sums = recent.groupBy(F.col("target_id").alias("id")).agg(F.sum(weight * F.exp(-age / (SALIENCE_SCALE_DAYS * 86400))).alias("s"))
    return targets.select("id").join(sums, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).cast("float").alias("salience"))


def usage(entity: str, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """How many claims and mentions stand in the way of a deletion."""
    c = claims.where((F.col("subject_id") == entity) | (F.col("object_entity_id") == entity)).agg(F.count("*").alias("claim_count"))
    m = mentions.where(F.col("entity_id") == entity).agg(F.count("*").alias("mention_count"), F.sort_array(F.collect_set("surface_form")).alias("surface_forms"))
    return c.join(m)
