"""Captures, corrections, disambiguations and batch merging: flows over several tables, as pure transforms like those of
:mod:`lattica.operators.lifecycle`. Ids of new rows come from the caller, so that a retry makes the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.names import AUTO_MERGE, DISAMBIGUATE, REUSE, match_score
from lattica.operators import lifecycle, resolve
from lattica.operators.graph import flatten_chains
from lattica.operators.lifecycle import Change, audit_rows, match_choice, one
from lattica.sources.durable import canonical_pairs, durable

#: What a provisional binding's context is marked with, and that it came from a claim.
PROVISIONAL, FROM_CLAIM = "provisional_binding", "claim"
MANUAL = "manual"
Tables = dict[str, DataFrame]


def added(df: DataFrame, *rows: dict) -> DataFrame:
    """``df`` with more rows; columns that a row does not name are null."""
    spark, fields = df.sparkSession, df.schema.fields
    made = spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    return df.unionByName(made)


def in_json(columns: dict[str, Column]) -> Column:
    """The evidence of a decision as a JSON document; unknown values stay as nulls."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})


# Splitting by mention and by claims


def with_target(entities: DataFrame, kind: str, target: dict) -> DataFrame:
    """``entities`` with the target, which is an existing id, or a new entity (id, canonical_name, kind, aliases)."""
    if entities.where(F.col("id") == target["id"]).take(1):
        return entities
    name = (target.get("canonical_name") or "").strip()
    if not name:
        raise ValueError("a new entity needs a name")
    return added(entities, {**target, "canonical_name": name, "kind": target.get("kind", kind), "aliases": target.get("aliases", [])})


def split_mention(entities: DataFrame, mentions: DataFrame, source: str, target: dict, experience, surface: str, field: str, reason: str, now: Column, by: str) -> Change:
    """Give one mention (experience, surface form, field) of ``source`` to ``target``; others of the experience stay."""
    kind = one(entities, "id", source)["kind"]
    me = (F.col("entity_id") == source) & (F.col("experience_id") == experience) & (F.col("surface_form") == surface) & (F.col("field") == field)
    moved = mentions.where(me)
    after = mentions.withColumn("entity_id", F.when(me, F.lit(target["id"])).otherwise(F.col("entity_id"))).dropDuplicates(["experience_id", "entity_id", "surface_form", "field"])
    place = {"experience_id": F.col("experience_id"), "surface_form": F.col("surface_form"), "field": F.col("field")}
    audit = audit_rows(moved.limit(1), "entity", "entity_id", place, place | {"split_into": F.lit(target["id"])}, F.lit(reason), now, by)
    return Change({"entities": with_target(entities, kind, target), "mentions": after}, audit, {"mentions": moved.count()})


def split_claims(entities: DataFrame, claims: DataFrame, sources: DataFrame, source: str, target: dict, experience, reason: str, now: Column, by: str) -> Change:
    """Give the claims that one experience supports to ``target``, at whichever end names ``source``."""
    kind = one(entities, "id", source)["kind"]
    here = sources.where(F.col("experience_id") == experience).select(F.col("claim_id").alias("id")).distinct().withColumn("_here", F.lit(True))
    marked = claims.join(here, "id", "left").withColumn("_move", F.coalesce("_here", F.lit(False)) & ((F.col("subject_id") == source) | F.coalesce(F.col("object_entity_id") == source, F.lit(False))))
    swap = lambda c: F.when(F.col("_move") & (F.col(c) == source), F.lit(target["id"])).otherwise(F.col(c))
    after = marked.withColumns({c: swap(c) for c in ("subject_id", "object_entity_id")}).select(*claims.columns)
    moved = marked.where("_move").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("ids")).withColumn("entity", F.lit(source))
    audit = audit_rows(moved.where("n > 0"), "entity", "entity", {"claim_ids": F.col("ids")}, {"claim_ids": F.col("ids"), "split_into": F.lit(target["id"])}, F.lit(reason), now, by)
    return Change({"entities": with_target(entities, kind, target), "claims": after}, audit, {"claims": marked.where("_move").count()})


# Corrections


def propose_correction(corrections: DataFrame, id, target_kind: str, target_id: str, change: dict, reason: str | None = None) -> DataFrame:
    return added(corrections, {"id": id, "target_kind": target_kind, "target_id": target_id, "suggested_change": json.dumps(change or {}), "reason": reason, "status": "pending"})


def correction_steps(change: dict, target: str) -> tuple[str, dict]:
    """The repair that a suggested change asks for, and what it is given; a change that names none, or too little, is refused."""
    text = lambda *names, otherwise=None: next((change[n] for n in names if isinstance(change.get(n), str) and change[n].strip()), otherwise)
    dicts = lambda *names: next((change[n] for n in names if isinstance(change.get(n), dict)), None)
    ids = change.get("experience_ids")
    known = {
        "repoint_participant": ("split", {"source": text("source_entity_id", "current_entity_id"), "experience_ids": ids if isinstance(ids, list) else [target], "into": dicts("into", "new_entity")}),
        "rename": ("rename", {"entity": text("entity_id", otherwise=target), "name": text("new_canonical_name")}),
        "retract": ("retract", {"claim": text("claim_id", otherwise=target)}),
    }
    if change.get("action") not in known:
        raise ValueError(f"unknown correction {change.get('action')!r}")
    tool, given = known[change["action"]]
    missing = [k for k, v in given.items() if not v]
    if missing:
        raise ValueError(f"{change['action']} needs {', '.join(missing)}")
    return tool, given | {"reason": text("reason")}


def resolve_correction(tables: Tables, id, decision: str, new_id: str, now: Column, by: str, reason: str | None = None) -> Change:
    """Apply or reject a pending proposal. The repair and the proposal's new status are one change, so a repair that
    fails leaves the proposal pending. ``new_id`` is for the entity that a split may make.
    """
    if decision not in ("apply", "reject"):
        raise ValueError("a decision is apply or reject")
    row = one(tables["corrections"], "id", id)
    status = {"apply": "applied", "reject": "rejected"}[decision]
    stamped = lifecycle.resolved(tables["corrections"], "id", id, status, now, ("applied", "rejected"))
    nothing = audit_rows(tables["corrections"].limit(0), "entity", "target_id", {"id": F.lit("")}, {"id": F.lit("")}, F.lit(""), now, by)
    if decision == "reject":
        return Change({"corrections": stamped}, nothing)
    tool, given = correction_steps(json.loads(row["suggested_change"]), row["target_id"])
    why = given["reason"] or reason or "correction applied"
    if tool == "split":
        into = {"id": new_id, **given["into"]}
        scope = tables["experiences"].select("id").where(F.col("id").cast("string").isin([str(x) for x in given["experience_ids"]]))
        done = lifecycle.split_entity(*(tables[n] for n in ("entities", "mentions", "claims", "sources")), given["source"], into, scope, now, by)
    elif tool == "rename":
        done = lifecycle.rename(tables["entities"], given["entity"], given["name"], now, by)
    else:
        claim = next((f.dataType for f in tables["claims"].schema.fields if f.name == "id"), None)
        done = lifecycle.retract_claim(tables["claims"], int(given["claim"]) if isinstance(claim, T.LongType) else given["claim"], why, now, by)
    return Change(done.tables | {"corrections": stamped}, done.audit, done.counts)


def resolve_merge_candidate(entities: DataFrame, candidates: DataFrame, id, decision: str, winner: str | None, now: Column, by: str, reason: str = "") -> Change:
    """Merge a pending pair into its ``winner``, or rule it apart, which writes no audit row."""
    if decision not in ("confirm", "reject"):
        raise ValueError("a decision is confirm or reject")
    row = one(candidates, "id", id)
    apart = lifecycle.resolved(candidates, "id", id, "kept_separate", now, ("kept_separate",))
    if decision == "reject":
        return Change({"candidates": apart}, audit_rows(candidates.limit(0), "entity", "entity_a", {"id": F.lit("")}, {"id": F.lit("")}, F.lit(""), now, by))
    ends = {row["entity_a"], row["entity_b"]}
    if winner not in ends:
        raise ValueError("the winner is one of the pair")
    return lifecycle.merge(entities, candidates, (ends - {winner}).pop(), winner, now, by, reason)


# Disambiguations


def request_disambiguation(rows: DataFrame, token: str, question: str, options: list[dict], context: dict | None = None) -> DataFrame:
    if not question.strip() or not isinstance(options, list) or len(options) < 2:
        raise ValueError("a question and at least two options are needed")
    return added(rows, {"token": token, "question": question, "options": json.dumps(options), "context": json.dumps(context) if context else None, "status": "pending"})


def provisional_binding(token: str, experience, surface: str, field: str, kind: str, entity: str, name: str, trigram: float, verified: float | None, source: str = "mention") -> dict:
    """The question whether a best guess was right; confirming adds the alias, rejecting moves what the guess bound."""
    context = {"kind": PROVISIONAL, "source": source, "experience_id": experience, "surface": surface, "field": field, "entity_kind": kind, "provisional_entity_id": entity, "trgm_score": trigram, "verification_score": verified}
    options = [{"label": f"Same as {name}", "value": {"action": "confirm"}}, {"label": f"Someone new: {surface}", "value": {"action": "reject"}}]
    return {"token": token, "question": f"Is {surface} the same as {name}?", "options": json.dumps(options), "context": json.dumps(context), "status": "pending"}


def resolve_disambiguation(tables: Tables, token: str, choice: Any, new_id: str, now: Column, by: str) -> Change:
    """Stamp the choice and, for a provisional binding, reconcile it: both are one change, so a failure leaves it pending."""
    rows = tables["disambiguations"]
    row = one(rows, "token", token)
    options = json.loads(row["options"])
    chosen = options[match_choice(options, choice)]
    stamped = lifecycle.resolved(rows, "token", token, "resolved", now, ("resolved",))
    stamped = stamped.withColumn("resolved_choice", F.when(F.col("token") == token, F.lit(json.dumps(chosen))).otherwise(F.col("resolved_choice")))
    nothing = audit_rows(rows.limit(0), "entity", "token", {"id": F.lit("")}, {"id": F.lit("")}, F.lit(""), now, by)
    context = json.loads(row["context"]) if row["context"] else {}
    if context.get("kind") != PROVISIONAL:
        return Change({"disambiguations": stamped}, nothing)
    action, entity = (chosen.get("value") or {}).get("action"), context["provisional_entity_id"]
    if action == "confirm":
        return Change({"disambiguations": stamped, "entities": lifecycle.append_alias(tables["entities"], entity, context["surface"])}, nothing)
    if action != "reject":
        raise ValueError("a binding is confirmed or rejected")
    target = {"id": new_id, "canonical_name": context["surface"], "kind": context["entity_kind"]}
    if context.get("source") == FROM_CLAIM:
        done = split_claims(tables["entities"], tables["claims"], tables["sources"], entity, target, context["experience_id"], "binding rejected", now, by)
    else:
        done = split_mention(tables["entities"], tables["mentions"], entity, target, context["experience_id"], context["surface"], context["field"], "binding rejected", now, by)
    return Change(done.tables | {"disambiguations": stamped}, done.audit, done.counts)


# Captures


def capture(
    tables: Tables, id, content: str, embedding: Sequence[float] | None, now: Column, new_id: Callable[[], str], owner: str | None = None, visibility: str = "private", occurred_at=None,
    participants: list[dict] | None = None, hints: list[dict] | None = None, source_kind: str | None = None, source_ref: str | None = None, lat: float | None = None, lng: float | None = None,
    client: str = "api", metadata: dict | None = None, extract: Callable[[str], dict] | None = None,
) -> Change:
    """A new experience. With a time, participants, hints or a source it is structured: participants are linked, and no
    metadata is extracted; else ``extract`` gives the metadata. Where a participant's name was only a good guess, a
    question is opened. ``counts`` holds how the participants were bound.
    """
    if not content.strip():
        raise ValueError("content is needed")
    structured = any([occurred_at is not None, participants, hints, source_kind is not None, source_ref is not None])
    people = [{**p, "name": (p.get("name") or "").strip()} for p in participants or []]
    about: dict = {"source": client, "people": [p["name"] for p in people]} if structured else {**(extract(content) if extract else {}), "source": client}
    about |= ({"predicate_hints": hints} if hints else {}) | (metadata or {})
    row = {"id": id, "content": content, "embedding": list(embedding) if embedding is not None else None, "metadata": json.dumps(about), "owner": owner, "visibility": visibility, "occurred_at": occurred_at, "source_kind": source_kind or MANUAL, "source_ref": source_ref, "lat": lat, "lng": lng}
    experiences = added(tables["experiences"], row)
    experiences = experiences.withColumn("captured_at", F.when((F.col("id") == id) & F.col("captured_at").isNull(), now).otherwise(F.col("captured_at")))
    out: Tables = {"experiences": experiences}
    nothing = audit_rows(tables["experiences"].limit(0), "entity", "id", {"id": F.lit("")}, {"id": F.lit("")}, F.lit(""), now, client)
    entities, mentions, questions, audit, counts = tables["entities"], [], [], nothing, {}
    for p in (p for p in people if p["name"]):
        if p.get("entity_id"):
            if one(entities, "id", p["entity_id"])["merged_into"]:
                raise ValueError("a participant's entity is merged")
            bound, action = p["entity_id"], "provided"
        else:
            entities, bound, action, question, more = bind(entities, p["name"], "person", embedding, id, "people", new_id, now, client)
            questions += question
            audit = audit.unionByName(more) if more is not None else audit
        mentions.append({"experience_id": id, "entity_id": bound, "surface_form": p["name"], "field": "people"})
        counts[action] = counts.get(action, 0) + 1
    if mentions:
        out |= {"entities": entities, "mentions": added(tables["mentions"], *mentions).dropDuplicates(["experience_id", "entity_id", "surface_form", "field"])}
    if questions:
        out["disambiguations"] = added(tables["disambiguations"], *questions)
    return Change(out, audit, counts)


def bind(entities: DataFrame, name: str, kind: str, embedding: Sequence[float] | None, experience, field: str, new_id: Callable[[], str], now: Column, by: str) -> tuple:
    """(entities, the entity bound, action, questions, audit): reuse it, mint and merge, bind for now and ask, or create."""
    best = resolve.resolve_entity(entities, name, kind, embedding if "embedding" in entities.columns else None, 20).orderBy(F.desc("trgm_score"), "entity_id").limit(1).collect()
    score = best[0]["trgm_score"] if best else 0.0
    if score > REUSE:
        return lifecycle.append_alias(entities, best[0]["entity_id"], name), best[0]["entity_id"], "matched", [], None
    fresh = {"id": new_id(), "kind": kind, "canonical_name": name, "aliases": []}
    if score <= DISAMBIGUATE:
        return added(entities, fresh), fresh["id"], "created", [], None
    held = one(entities, "id", best[0]["entity_id"])
    verified = match_score(kind, [name], kind, [held["canonical_name"], *(held["aliases"] or [])])
    if verified >= AUTO_MERGE:
        done = lifecycle.merge(added(entities, fresh), None, fresh["id"], held["id"], now, by, "verified at capture")
        return done.tables["entities"], held["id"], "auto_merged", [], done.audit
    question = provisional_binding(new_id(), experience, name, field, kind, held["id"], held["canonical_name"], float(score), verified)
    return entities, held["id"], "provisional", [question], None


def upsert_thought(experiences: DataFrame, id, content: str, metadata: dict, embedding: Sequence[float] | None, now: Column) -> tuple[DataFrame, DataFrame]:
    """The plain way in: the table with one manual experience more, and that row."""
    row = {"id": id, "content": content, "metadata": json.dumps(metadata), "embedding": list(embedding) if embedding is not None else None, "source_kind": MANUAL, "visibility": "private"}
    after = added(experiences, row).withColumn("captured_at", F.when((F.col("id") == id) & F.col("captured_at").isNull(), now).otherwise(F.col("captured_at")))
    return after, after.where(F.col("id") == id)


# Batch merging


def dedup_counts(plan: DataFrame, entities: DataFrame) -> DataFrame:
    """The dry run's report: pairs by kind and action."""
    kinds = entities.select(F.col("id").alias("winner"), "kind")
    return plan.join(kinds, "winner").groupBy("kind", "action").agg(F.count("*").alias("n"))


def apply_dedup(entities: DataFrame, candidates: DataFrame, plan: DataFrame, now: Column, by: str) -> Change:
    """All merges of a plan at once, and its queue as pending candidates unless the pair is known.

    A loser goes to its best winner (by score, then id), and winners that lose, too, are followed to the last one; the plan
    orders winners by their names and ids, so there are no cycles. A winner gains the names of all that end in it, each
    once, in the order of their ids.
    """
    best = plan.where("action = 'merge'").groupBy(F.col("loser").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("s"), "winner")).getField("winner").alias("merged_into"))
    linked = entities.select("id").join(best, "id", "left")
    ends = flatten_chains(linked).where(F.col("terminal").isNotNull()).select("id", F.col("terminal").alias("_into"))
    ends = durable(ends, "merge-ends")
    moved = entities.join(ends, "id", "left")
    # What was merged into a loser before follows it.
    over = ends.select(F.col("id").alias("merged_into"), F.col("_into").alias("_over"))
    moved = moved.join(over, "merged_into", "left").withColumn("_new", F.coalesce("_into", "_over", "merged_into"))
    lost = entities.join(ends, "id").select(F.col("_into").alias("id"), F.struct(F.col("id").alias("loser"), F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names")).alias("l"))
    gained = lost.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["names"])).alias("_names"))
    held = F.coalesce("aliases", F.array().cast("array<string>"))
    names = F.array_distinct(F.filter(F.concat(held, "_names"), lambda x: x.isNotNull() & (x != F.col("canonical_name"))))
    after = moved.join(gained, "id", "left").withColumns({"aliases": F.when(F.col("_names").isNotNull(), names).otherwise(F.col("aliases")), "merged_into": F.col("_new")}).select(*entities.columns)
    changed = moved.where(F.coalesce("_into", "_over").isNotNull())
    audit = audit_rows(changed, "entity", "id", {"merged_into": F.col("merged_into")}, {"merged_into": F.col("_new"), "compressed_via": F.when(F.col("_into").isNull(), F.col("merged_into"))}, F.lit("merged by deduplication"), now, by)
    queue = canonical_pairs(plan.where("action = 'queue'").select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), F.col("score").alias("similarity")))
    fresh = queue.join(candidates.select("entity_a", "entity_b"), ["entity_a", "entity_b"], "left_anti").withColumns({"status": F.lit("pending"), "created_at": now})
    return Change({"entities": after, "candidates": candidates.unionByName(fresh, allowMissingColumns=True)}, audit, {})
