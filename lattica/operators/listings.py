"""Listings, details and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.predicates import all_of, contains, in_bbox, live, since, visible
from lattica.functions.text import BUCKETS, day_bucket, recency, snippet
from lattica.operators.search import tagged


def page(ordered: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return ordered.offset(offset).limit(limit)


def page_with_more(ordered: DataFrame, limit: int, offset: int = 0) -> tuple[list, bool, int | None]:
    """Rows of a page, whether there are more, and where the next begins; one row too many is asked for."""
    rows = page(ordered, limit + 1, offset).collect()
    more = len(rows) > limit
    return rows[:limit], more, offset + limit if more else None


def counted_page(ordered: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, int, bool]:
    """A page, the number of all rows, and whether that is more than the page reaches."""
    total = ordered.count()
    return page(ordered, limit, offset), total, offset + limit < total


def thoughts(experiences: DataFrame) -> DataFrame:
    """The plain view of experiences, deleted and superseded ones included; ``createOrReplaceTempView`` gives it a name."""
    return experiences.select("id", "content", "embedding", "metadata", F.col("captured_at").alias("created_at"))


def list_thoughts(experiences: DataFrame, now: Column, viewer: str | None = None, type: str | None = None, topic: str | None = None, person: str | None = None, days: int | None = None, limit: int = 10) -> DataFrame:
    """Newest first; deleted and superseded ones are listed, too."""
    conditions = [visible(viewer)]
    for wanted in ({"type": type} if type else None, {"topics": [topic]} if topic else None, {"people": [person]} if person else None):
        if wanted:
            conditions.append(contains("metadata", wanted))
    if days is not None:
        conditions.append(since("captured_at", now, days))
    return experiences.where(all_of(conditions)).orderBy(F.desc("captured_at"), "id").limit(limit).select("id", "content", "metadata", F.col("captured_at").alias("created_at"))


def recent_feed(experiences: DataFrame, mentions: DataFrame, entities: DataFrame, viewer: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """The newest live and visible ones with a snippet and the names of their entities."""
    newest = page(experiences.where(live() & visible(viewer)).orderBy(F.desc("captured_at"), "id"), limit, offset)
    base = newest.select("id", snippet(F.col("content"), 280).alias("snippet"), "captured_at", "source_kind", "visibility", "lat", "lng")
    return tagged(base, mentions, entities).orderBy(F.desc("captured_at"), "id")


def day_buckets(experiences: DataFrame, now: Column) -> DataFrame:
    bucket = day_bucket(F.col("captured_at"), now)
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")).cast("int")
    return experiences.where(live()).select("id", bucket.alias("bucket")).withColumn("bucket_order", order)


def in_box(experiences: DataFrame, box: tuple[float, float, float, float], viewer: str | None = None, limit: int = 500) -> DataFrame:
    df = experiences.where(live() & visible(viewer) & in_bbox(*box))
    return df.orderBy(F.desc_nulls_last("occurred_at"), F.desc("captured_at"), "id").limit(limit).select("id", "lat", "lng", "occurred_at", "captured_at")


def entity_timeline(experiences: DataFrame, mentions: DataFrame, entity: str, viewer: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Live and visible experiences that mention the stored entity, newest occurrence first."""
    here = mentions.where(F.col("entity_id") == entity).select(F.col("experience_id").alias("id"))
    forms = mentions.where(F.col("entity_id") == entity).groupBy(F.col("experience_id").alias("id")).agg(F.min("surface_form").alias("surface_form"))
    rows = experiences.where(live() & visible(viewer)).join(here, "id", "left_semi").select("id", "content", "captured_at", "occurred_at")
    return page(rows.join(forms, "id").orderBy(F.desc_nulls_last("occurred_at"), F.desc("captured_at"), "id"), limit, offset)


def entity_detail(entity: str, entities: DataFrame, claims: DataFrame, sources: DataFrame, mentions: DataFrame, experiences: DataFrame, viewer: str | None = None) -> dict[str, DataFrame]:
    """The entity, where it was merged to, its claims as subject and object with their sources, and its timeline."""
    row = entities.where(F.col("id") == entity)
    winner = row.select(F.col("merged_into").alias("id")).join(entities, "id")
    counts = sources.groupBy(F.col("claim_id").alias("id")).agg(F.count("*").alias("source_count"))
    own = lambda c: claims.where(F.col(c) == entity).join(counts, "id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0))).orderBy(F.desc_nulls_last("confidence"), "created_at", "id")
    return {"entity": row, "winner": winner, "as_subject": own("subject_id"), "as_object": own("object_entity_id"), "timeline": entity_timeline(experiences, mentions, entity, viewer)}


def experience_detail(experience: int, experiences: DataFrame, mentions: DataFrame, entities: DataFrame, claims: DataFrame, sources: DataFrame, viewer: str | None = None) -> dict[str, DataFrame]:
    own = F.lit(viewer is None) | F.coalesce(F.col("owner") == F.lit(viewer), F.lit(False))
    row = experiences.where((F.col("id") == experience) & visible(viewer)).withColumns({"is_live": live(), "can_change_visibility": own})
    people = mentions.where(F.col("experience_id") == experience).join(entities.select(F.col("id").alias("entity_id"), "canonical_name", "kind"), "entity_id").orderBy("field", "canonical_name", "entity_id")
    links = sources.where(F.col("experience_id") == experience)
    named = entities.select(F.col("id").alias("object_entity_id"), F.col("canonical_name").alias("object_name"))
    stated = links.join(claims, links.claim_id == claims.id).join(named, "object_entity_id", "left").orderBy(F.desc_nulls_last("confidence"), "created_at", "claim_id")
    return {"experience": row, "mentions": people, "claims": stated}


def recent_entities(entities: DataFrame, now: Column, days: int, limit: int = 200) -> DataFrame:
    return entities.where(since("created_at", now, days, strict=True)).orderBy(F.desc("created_at"), "id").limit(limit)


def with_recency(rows: DataFrame, column: str, now: Column) -> DataFrame:
    return rows.withColumn("recency", recency(F.col(column), now))
