"""The claim graph: bounded confidence-weighted traversal, who was where, hubs and merge chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.predicates import on_date
from lattica.sources.durable import durable

MAX_HOPS = 3
#: A frontier of at most so many stored ids is broadcast: 10 MB of ids and products.
MAX_BROADCAST = 100_000


def survivors(entities: DataFrame) -> DataFrame:
    """(stored, survivor) for every entity; merges are one level deep."""
    return entities.select(F.col("id").alias("stored"), F.coalesce("merged_into", "id").alias("survivor"))


def held(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``df`` computed once, and whether it has at most ``MAX_BROADCAST`` rows: these stay at hand, more are written."""
    rows = df.take(MAX_BROADCAST + 1)
    if len(rows) > MAX_BROADCAST:
        return durable(df, name), False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def relationships_to(claims: DataFrame, entities: DataFrame, seed: str, max_hops: int = 2, min_confidence: float = 0.0) -> DataFrame:
    """entity_id, canonical_name, kind, hops and confidence of what is within reach of ``seed``.

    Confidences lie in [0, 1], so a cycle never raises a product: the best product for each node and number of hops is
    enough, and paths are never enumerated. A hop meets only the claims at the frontier: the frontier's survivors are
    expanded to the ids merged into them, which select from the claims before anything is shuffled while they are few.
    """
    if not 1 <= max_hops <= MAX_HOPS or not 0 <= min_confidence <= 1:
        raise ValueError(f"max_hops must be 1 to {MAX_HOPS} and min_confidence 0 to 1")
    known = durable(entities.select(F.col("id").alias("stored"), F.coalesce("merged_into", "id").alias("survivor"), "canonical_name", "kind"), "survivors")
    dim = known.select("stored", "survivor")
    origin = dim.where(F.col("stored") == seed).select(F.col("survivor").alias("node"))
    bound = claims.where((F.col("polarity") != "retracted") & F.col("object_entity_id").isNotNull())
    both = F.array(*(F.struct(F.col(x).alias("stored"), F.col(y).alias("other")) for x, y in (("subject_id", "object_entity_id"), ("object_entity_id", "subject_id"))))
    ends = bound.select(F.explode(both).alias("e"), F.col("confidence").cast("float").alias("claimed")).select("e.*", "claimed")
    (frontier, few), reached = held(origin.withColumn("confidence", F.lit(1.0).cast("float")), "origin"), []
    origin = frontier.select("node")
    for hop in range(1, max_hops + 1):
        members = dim.join(F.broadcast(frontier) if few else frontier, F.col("survivor") == F.col("node")).select("stored", "node", F.col("confidence").alias("so_far"))
        members, narrow = held(members, "frontier")
        members = F.broadcast(members) if narrow else members
        step = ends.join(members, "stored").withColumn("confidence", (F.col("so_far") * F.col("claimed")).cast("float")).where(F.col("confidence") >= F.lit(min_confidence).cast("float"))
        met = step.select(F.col("node").alias("src"), F.col("other").alias("stored"), "confidence").join(dim, "stored")
        found = met.where(F.col("survivor") != F.col("src")).groupBy(F.col("survivor").alias("node")).agg(F.max("confidence").alias("confidence"))
        frontier, few = held(found.join(F.broadcast(origin), "node", "left_anti"), "reached")  # the origin is one row
        reached.append(frontier.withColumn("hops", F.lit(hop)))
    found = reduce(DataFrame.union, reached).groupBy("node").agg(F.min("hops").alias("hops"), F.max("confidence").alias("confidence"))
    names = known.select(F.col("stored").alias("node"), "canonical_name", "kind")
    return found.join(names, "node").select(F.col("node").alias("entity_id"), "canonical_name", "kind", "hops", "confidence").orderBy("hops", "canonical_name", "entity_id")


def who_was_at(experiences: DataFrame, mentions: DataFrame, entities: DataFrame, experience_id: int | None = None, day: Column | None = None) -> DataFrame:
    """Entities of one experience, or of one date (each once, with its smallest field); merges are not followed."""
    if (experience_id is None) == (day is None):
        raise ValueError("give an experience or a day")
    chosen = experiences.where(F.col("id") == experience_id if day is None else on_date(day)).select(F.col("id").alias("experience_id"), "occurred_at")
    named = entities.select(F.col("id").alias("entity_id"), "canonical_name", "kind")
    rows = mentions.join(chosen, "experience_id").join(named, "entity_id")
    first = W.partitionBy("entity_id").orderBy("field", "experience_id", "surface_form")
    out = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return out.select("entity_id", "canonical_name", "kind", "surface_form", "occurred_at")


def split_candidates(claims: DataFrame, entities: DataFrame, min_degree: int = 5, limit: int = 20, excluded: list[str] | None = None) -> DataFrame:
    """Hubs: survivors by the number of distinct claims at them; a claim with itself counts once."""
    ends = [claims.where(F.col("polarity") != "retracted").select(F.col(c).alias("stored"), F.col("id").alias("claim")) for c in ("subject_id", "object_entity_id")]
    touching = ends[0].union(ends[1]).join(survivors(entities), "stored").select("survivor", "claim").distinct()
    degree = touching.groupBy(F.col("survivor").alias("id")).agg(F.count("*").alias("degree")).where(F.col("degree") >= min_degree)
    out = degree.join(entities.select("id", "canonical_name", "kind"), "id")
    out = out.where(~F.col("canonical_name").isin(excluded)) if excluded else out
    return out.orderBy(F.desc("degree"), "id").limit(limit)


def flatten_chains(entities: DataFrame) -> DataFrame:
    """(id, terminal, hops) of every merged entity by pointer jumping, however long the chain.

    Entities on a cycle, or that lead into one, have a null terminal: after as many rounds as the number of merged
    entities has bits, all chains have ended, and what still moves goes round. A pointer to nothing is a terminal.
    """
    links = entities.where(F.col("merged_into").isNotNull()).select("id", F.col("merged_into").alias("to"), F.lit(1).cast("long").alias("hops"))
    links = durable(links, "chains")
    for _ in range(links.count().bit_length()):
        after = links.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        moved = links.join(after, "to", "left")
        if not moved.where(F.col("next").isNotNull()).take(1):
            break
        # Written each time: otherwise the plan doubles with every round.
        links = durable(moved.select("id", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "chains")
    still = entities.where(F.col("merged_into").isNotNull()).select(F.col("id").alias("to"), F.lit(True).alias("cyclic"))
    return links.join(still, "to", "left").select("id", F.when(F.col("cyclic").isNull(), F.col("to")).alias("terminal"), "hops")


def chain_violations(entities: DataFrame) -> DataFrame:
    """Entities merged into one that is itself merged, or is missing."""
    target = entities.select(F.col("id").alias("t"), F.col("merged_into").alias("t_into"))
    return entities.where(F.col("merged_into").isNotNull()).join(target, F.col("merged_into") == F.col("t"), "left").where(F.col("t").isNull() | F.col("t_into").isNotNull()).select("id", "merged_into")


def experience_ids_mentioning(name: str, entities: DataFrame, mentions: DataFrame, kind: str | None = None) -> DataFrame:
    """Experiences that mention an entity of this name or alias, or one that was merged into it over any number of steps.

    The entities found so far are written after each step and only new ones go on, so a cycle ends.
    """
    wanted = name.strip().lower()
    match = (F.lower(F.trim("canonical_name")) == wanted) | F.exists("aliases", lambda a: F.lower(F.trim(a)) == wanted)
    level = found = durable(entities.where(match & (F.col("kind") == kind if kind else F.lit(True))).select("id").distinct(), "named")
    losers = entities.where(F.col("merged_into").isNotNull()).select("id", "merged_into")
    while level.take(1):
        more = losers.join(level.select(F.col("id").alias("merged_into")), "merged_into", "left_semi").select("id").distinct()
        level = durable(more.join(found, "id", "left_anti"), "merged")
        found = found.union(level)
    return mentions.join(found.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(F.col("experience_id").alias("id")).distinct()
