"""Review queues and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import actor, change_type, snippet
from lattica.operators.aggregates import survivor_mention_counts
from lattica.operators.graph import split_candidates
from lattica.sources.durable import durable

#: What counts as low confidence, and how long a queue is.
LOW_CONFIDENCE, QUEUE = 0.6, 200


def low_confidence(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Inferred claims below the bar, one row for each source."""
    inferred = sources.where(F.col("support_kind") == "inferred").select("claim_id", "experience_id")
    weak = claims.where((F.col("confidence") < F.lit(LOW_CONFIDENCE)) & (F.col("polarity") != "retracted")).select(F.col("id").alias("claim_id"), "subject_id", "predicate", "confidence", "created_at")
    return weak.join(inferred, "claim_id")


def low_confidence_queue(claims: DataFrame, sources: DataFrame, limit: int = QUEUE) -> DataFrame:
    return low_confidence(claims, sources).orderBy("confidence", "created_at", "claim_id").limit(limit)


def contradictions(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("superseded_by").isNotNull() & (F.col("polarity") != "retracted")).select("id", "subject_id", "predicate", "superseded_by", "created_at")


def pending(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "pending").orderBy("created_at", "id")


def low_impact(candidates: DataFrame, entities: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidates with ``deferred``: both concepts, no claim at either stored id, and each survivor in one experience at most."""
    kinds = entities.select("id", "kind", F.coalesce("merged_into", "id").alias("survivor"))
    active = claims.where(F.col("polarity") != "retracted")
    touched = active.select(F.col("subject_id").alias("id")).union(active.select("object_entity_id")).dropna().distinct().withColumn("claimed", F.lit(True))
    counts = survivor_mention_counts(mentions, entities)
    ends = candidates.select(F.col("entity_a").alias("id")).union(candidates.select("entity_b")).distinct()
    known = durable(kinds.join(ends, "id", "left_semi").join(touched, "id", "left").join(counts, "survivor", "left"), "candidate-ends")
    df = candidates
    for end in ("a", "b"):
        dim = known.select(F.col("id").alias(f"entity_{end}"), F.col("kind").alias(f"kind_{end}"), F.coalesce("claimed", F.lit(False)).alias(f"claimed_{end}"), F.coalesce("n", F.lit(0)).alias(f"n_{end}"))
        df = df.join(dim, f"entity_{end}")
    quiet = (F.col("kind_a") == "concept") & (F.col("kind_b") == "concept") & ~F.col("claimed_a") & ~F.col("claimed_b") & (F.col("n_a") <= 1) & (F.col("n_b") <= 1)
    return df.withColumn("deferred", quiet).select(*candidates.columns, "deferred")


def merge_queue(candidates: DataFrame, entities: DataFrame, claims: DataFrame, mentions: DataFrame, limit: int = QUEUE) -> tuple[DataFrame, DataFrame]:
    """The pending candidates worth a look, most similar first, and how many are put off."""
    judged = low_impact(candidates.where(F.col("status") == "pending"), entities, claims, mentions)
    shown = judged.where(~F.col("deferred")).drop("deferred").orderBy(F.desc_nulls_last("similarity"), "created_at", "id").limit(limit)
    return attach_names(shown, entities), judged.agg(F.coalesce(F.sum(F.col("deferred").cast("long")), F.lit(0)).alias("deferred"))


def attach_names(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        candidates = candidates.join(entities.select(F.col("id").alias(f"entity_{end}"), F.col("canonical_name").alias(f"name_{end}")), f"entity_{end}", "left")
    return candidates


def evidence(candidates: DataFrame, mentions: DataFrame, experiences: DataFrame, per_side: int = 2) -> DataFrame:
    """The newest experiences that mention either end: entity_id, experience_id, snippet, k."""
    from pyspark.sql import Window as W

    ends = candidates.select(F.col("entity_a").alias("entity_id")).union(candidates.select("entity_b")).distinct()
    text = experiences.select(F.col("id").alias("experience_id"), "content", "captured_at")
    rows = mentions.join(ends, "entity_id", "left_semi").select("entity_id", "experience_id").distinct().join(text, "experience_id")
    newest = W.partitionBy("entity_id").orderBy(F.desc("captured_at"), "experience_id")
    return rows.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= per_side).select("entity_id", "experience_id", snippet(F.col("content"), 120).alias("snippet"), "k")


def pending_counts(candidates: DataFrame, claims: DataFrame, sources: DataFrame, disambiguations: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row; hubs are not part of the total."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    waiting = F.col("status") == "pending"
    parts = [
        n(candidates.where(waiting), "merge_candidates"), n(low_confidence(claims, sources), "low_confidence_claims"), n(contradictions(claims), "contradictions"),
        n(disambiguations.where(waiting), "disambiguations"), n(corrections.where(waiting), "proposed_corrections"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part)
    return out.withColumn("total", sum((F.col(c) for c in out.columns), F.lit(0)))


def queue(kind: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One of the review queues by name."""
    made = {
        "merge_candidates": lambda t: merge_queue(t["candidates"], t["entities"], t["claims"], t["mentions"])[0],
        "low_confidence_claims": lambda t: low_confidence_queue(t["claims"], t["sources"]),
        "contradictions": lambda t: contradictions(t["claims"]).orderBy("created_at", "id"),
        "disambiguations": lambda t: pending(t["disambiguations"]),
        "proposed_corrections": lambda t: pending(t["corrections"]),
        "split_candidates": lambda t: split_candidates(t["claims"], t["entities"]),
    }
    if kind not in made:
        raise ValueError(f"unknown queue {kind!r}; one of {sorted(made)}")
    return made[kind](tables)


def activity(events: DataFrame, experiences: DataFrame, entities: DataFrame, claims: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The audit log, newest first: change_type, actor, and what its target and a merge's winner are called."""
    newest = events.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    kind = F.col("target_kind")
    rows = newest.withColumns({
        "change_type": change_type(kind, F.col("before"), F.col("after")), "actor": actor(F.coalesce("created_by", F.lit(""))),
        "_winner": F.when(kind == "entity", F.nullif(F.get_json_object("after", "$.merged_into"), F.lit(""))),
        **{f"_{k}": F.when(kind == k, F.col("target_id")) for k in ("experience", "entity", "claim")},
    })
    text = experiences.select(F.col("id").cast("string").alias("_experience"), snippet(F.col("content"), 120).alias("experience_snippet"))
    name = entities.select(F.col("id").alias("_entity"), F.col("canonical_name").alias("entity_name"))
    winner = entities.select(F.col("id").alias("_winner"), F.col("canonical_name").alias("winner_name"))
    said = claims.select(F.col("id").cast("string").alias("_claim"), F.col("predicate").alias("claim_predicate"), F.col("subject_id").alias("claim_subject"))
    for dim, key in ((text, "_experience"), (name, "_entity"), (winner, "_winner"), (said, "_claim")):
        rows = rows.join(dim, key, "left")
    return rows.drop("_experience", "_entity", "_winner", "_claim").orderBy(F.desc("created_at"), F.desc("id"))


def sources_by_kind(claims: DataFrame, sources: DataFrame, experiences: DataFrame, kind: str | None = None) -> DataFrame:
    """(experience_id, claim_id, support_kind) of the asserted claims that ``experiences`` (id) support; of one kind if given.

    With ``paraphrased`` these are the claims that an edit may ask to retract: only they survive a new wording by themselves.
    """
    here = sources.join(experiences.select(F.col("id").alias("experience_id")).distinct(), "experience_id", "left_semi")
    here = here.where(F.col("support_kind") == kind) if kind else here
    asserted = claims.where("polarity = 'asserted'").select(F.col("id").alias("claim_id"))
    return here.join(asserted, "claim_id", "left_semi").select("experience_id", "claim_id", "support_kind")
