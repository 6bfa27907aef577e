"""State changes as pure transforms: frames in, the frames after the change and its audit rows out.

Files are immutable, so a change is a new version of a table. An audit row is (target_kind, target_id, before, after,
reason, created_at, created_by) with JSON documents before and after.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.predicates import live
from lattica.functions.vector import cosine_distance
from lattica.operators.graph import flatten_chains

#: Fixed value: an edit stays in place above this cosine.
IN_PLACE = 0.95
#: Audit lineages are followed this far.
LINEAGE = 32


@dataclass
class Change:
    """Tables after a change and the audit rows to append."""

    tables: dict[str, DataFrame]
    audit: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def audit_rows(rows: DataFrame, kind: str, target: str, before: dict[str, Column], after: dict[str, Column], reason: Column, now: Column, by: str) -> DataFrame:
    doc = lambda d: F.to_json(F.struct(*(c.alias(k) for k, c in d.items())), {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("target_kind"), F.col(target).cast("string").alias("target_id"), doc(before).alias("before"), doc(after).alias("after"), reason.alias("reason"), now.alias("created_at"), F.lit(by).alias("created_by"))


def one(df: DataFrame, key: str, value) -> dict:
    rows = df.where(F.col(key) == value).limit(1).collect()
    if not rows:
        raise LookupError(f"no {key} {value!r}")
    return rows[0].asDict(recursive=True)


def merge(entities: DataFrame, candidates: DataFrame | None, loser: str, winner: str, now: Column, by: str, reason: str = "") -> Change:
    """Soft merge: the winner gains names, the loser points to it, and what pointed to the loser does, too."""
    if loser == winner:
        raise ValueError("an entity cannot be merged with itself")
    a, b = one(entities, "id", loser), one(entities, "id", winner)
    if a["merged_into"] or b["merged_into"]:
        raise ValueError("one of the entities is already merged")
    if a["kind"] != b["kind"]:
        raise ValueError("entities of different kinds cannot be merged")
    gained = [x for x in dict.fromkeys([*(b["aliases"] or []), a["canonical_name"], *(a["aliases"] or [])]) if x and x != b["canonical_name"]]
    moved = F.col("merged_into") == loser
    into = F.when((F.col("id") == loser) | moved, F.lit(winner)).otherwise(F.col("merged_into"))
    aliases = F.when(F.col("id") == winner, F.array(*map(F.lit, gained)).cast("array<string>")).otherwise(F.col("aliases"))
    after = entities.withColumns({"merged_into": into, "aliases": aliases})
    why = F.lit(reason or f"merged into {winner}")
    own = audit_rows(entities.where(F.col("id") == loser), "entity", "id", {"merged_into": F.col("merged_into"), "canonical_name": F.col("canonical_name")}, {"merged_into": F.lit(winner), "canonical_name": F.lit(b["canonical_name"])}, why, now, by)
    compressed = audit_rows(entities.where(moved), "entity", "id", {"merged_into": F.lit(loser)}, {"merged_into": F.lit(winner), "compressed_via": F.lit(loser)}, F.lit(f"path compression via {loser}"), now, by)
    tables = {"entities": after}
    if candidates is not None:
        pair = (F.col("entity_a") == min(loser, winner)) & (F.col("entity_b") == max(loser, winner))
        decided = pair & (F.col("status") == "pending")
        tables["candidates"] = candidates.withColumns({"resolved_at": F.when(decided, now).otherwise(F.col("resolved_at")), "status": F.when(decided, "merged").otherwise(F.col("status"))})
    return Change(tables, own.unionByName(compressed))


def unmerge(entities: DataFrame, events: DataFrame, candidates: DataFrame | None, entity: str, now: Column, by: str) -> Change:
    """Clear the pointer and those compressed via this entity; aliases stay. The pair that was decided is open again."""
    row = one(entities, "id", entity)
    if not row["merged_into"]:
        raise ValueError("the entity is not merged")
    winner = row["merged_into"]
    via = events.where((F.col("target_kind") == "entity") & (F.get_json_object("after", "$.compressed_via") == entity)).select(F.col("target_id").alias("id"), F.lit(True).alias("_back")).distinct()
    marked = entities.join(via, "id", "left").withColumn("_back", F.coalesce("_back", F.lit(False)) & (F.col("merged_into") == winner))
    into = F.when(F.col("id") == entity, F.lit(None)).when(F.col("_back"), F.lit(entity)).otherwise(F.col("merged_into"))
    after = marked.withColumn("merged_into", into).select(*entities.columns)
    own = audit_rows(entities.where(F.col("id") == entity), "entity", "id", {"merged_into": F.col("merged_into")}, {"merged_into": F.lit(None).cast("string")}, F.lit("unmerged"), now, by)
    back = audit_rows(marked.where("_back"), "entity", "id", {"merged_into": F.col("merged_into")}, {"merged_into": F.lit(entity)}, F.lit(f"restored by unmerge of {entity}"), now, by)
    tables = {"entities": after}
    if candidates is not None:
        other = decided_partner(events, entity, winner)
        reopened = (F.col("entity_a") == min(entity, other)) & (F.col("entity_b") == max(entity, other)) & (F.col("status") == "merged")
        tables["candidates"] = candidates.withColumns({"resolved_at": F.when(reopened, F.lit(None)).otherwise(F.col("resolved_at")), "status": F.when(reopened, "pending").otherwise(F.col("status"))})
    return Change(tables, own.unionByName(back))


def decided_partner(events: DataFrame, entity: str, winner: str) -> str:
    """Whom ``entity`` was judged against, back from what it points to now.

    Each later merge that moved the pointer on left an event with the pointer it wrote and the entity it went past. Of one
    entity's events, which are written by hand or one for each merge, at most ``LINEAGE`` steps are followed.
    """
    after = lambda k: F.get_json_object("after", f"$.{k}")
    moves = events.where((F.col("target_kind") == "entity") & (F.col("target_id") == entity) & after("compressed_via").isNotNull())
    past = {r["to"]: r["via"] for r in moves.groupBy(after("merged_into").alias("to")).agg(F.max_by(after("compressed_via"), "created_at").alias("via")).collect()}
    for _ in range(LINEAGE):
        if winner not in past:
            break
        winner = past[winner]
    return winner


def flatten(entities: DataFrame, now: Column, by: str) -> Change:
    """Point every merged entity at its terminal survivor; refuses cycles."""
    ends = flatten_chains(entities)
    if ends.where(F.col("terminal").isNull()).take(1):
        raise ValueError("merges form a cycle")
    longer = ends.where("hops > 1").select("id", "terminal")
    joined = entities.join(longer, "id", "left")
    after = joined.withColumn("merged_into", F.coalesce("terminal", "merged_into")).select(*entities.columns)
    audit = audit_rows(joined.where(F.col("terminal").isNotNull()), "entity", "id", {"merged_into": F.col("merged_into")}, {"merged_into": F.col("terminal")}, F.format_string("flattened merge chain to %s", "terminal"), now, by)
    return Change({"entities": after}, audit)


def rename(entities: DataFrame, entity: str, name: str, now: Column, by: str) -> Change:
    """The old name stays as an alias; the same name changes nothing and leaves no audit row."""
    if not name.strip():
        raise ValueError("a name is needed")
    row = one(entities, "id", entity)
    me = F.col("id") == entity
    audit = audit_rows(entities.where(me & F.lit(row["canonical_name"] != name)), "entity", "id", {"canonical_name": F.col("canonical_name")}, {"canonical_name": F.lit(name)}, F.lit("renamed"), now, by)
    if row["canonical_name"] == name:
        return Change({"entities": entities}, audit)
    aliases = [x for x in dict.fromkeys([*(row["aliases"] or []), row["canonical_name"]]) if x != name]
    after = entities.withColumns({"canonical_name": F.when(me, name).otherwise(F.col("canonical_name")), "aliases": F.when(me, F.array(*map(F.lit, aliases)).cast("array<string>")).otherwise(F.col("aliases"))})
    return Change({"entities": after}, audit)


def append_alias(entities: DataFrame, entity: str, alias: str) -> DataFrame:
    """Without an audit row; nothing happens if it is there."""
    held = F.coalesce("aliases", F.array().cast("array<string>"))
    absent = (F.col("id") == entity) & ~F.array_contains(held, alias) & (F.col("canonical_name") != alias)
    return entities.withColumn("aliases", F.when(absent, F.array_append(held, F.lit(alias))).otherwise(F.col("aliases")))


def retract_claim(claims: DataFrame, claim, reason: str, now: Column, by: str) -> Change:
    if not reason.strip():
        raise ValueError("a reason is needed")
    one(claims, "id", claim)
    me = (F.col("id") == claim) & (F.col("polarity") != "retracted")
    audit = audit_rows(claims.where(me), "claim", "id", {"polarity": F.col("polarity")}, {"polarity": F.lit("retracted")}, F.lit(reason), now, by)
    return Change({"claims": claims.withColumn("polarity", F.when(me, "retracted").otherwise(F.col("polarity")))}, audit)


def split_entity(entities: DataFrame, mentions: DataFrame, claims: DataFrame, sources: DataFrame, source: str, target: dict, experience_ids: DataFrame, now: Column, by: str) -> Change:
    """Move what ``experience_ids`` (id) say of ``source`` to ``target``: an existing id, or a new entity (id, kind, canonical_name).

    Claims move if any of their sources is in scope. Nothing moved leaves no audit row.
    """
    row = one(entities, "id", source)
    if not entities.where(F.col("id") == target["id"]).take(1):
        fresh = entities.where(F.col("id") == source).withColumns({"id": F.lit(target["id"]), "canonical_name": F.lit(target.get("canonical_name", row["canonical_name"])), "aliases": F.array(F.lit(target.get("canonical_name", row["canonical_name"]))), "merged_into": F.lit(None).cast("string")})
        entities = entities.unionByName(fresh)
    scope = experience_ids.select(F.col("id").alias("experience_id")).distinct().withColumn("_in", F.lit(True))
    marked = mentions.join(scope, "experience_id", "left").withColumn("_move", (F.col("entity_id") == source) & F.coalesce("_in", F.lit(False)))
    after_mentions = marked.withColumn("entity_id", F.when(F.col("_move"), target["id"]).otherwise(F.col("entity_id"))).select(*mentions.columns).dropDuplicates(["experience_id", "entity_id", "surface_form", "field"])
    touched = sources.join(scope, "experience_id", "left_semi").select(F.col("claim_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    of = claims.join(touched, "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    swap = lambda c: F.when(F.col("_in") & (F.col(c) == source), target["id"]).otherwise(F.col(c))
    after_claims = of.withColumns({"subject_id": swap("subject_id"), "object_entity_id": swap("object_entity_id")}).select(*claims.columns)
    moved = marked.where("_move").select("experience_id").union(of.where(F.col("_in") & ((F.col("subject_id") == source) | (F.col("object_entity_id") == source))).select(F.col("id")))
    ids = moved.agg(F.count("*").alias("n"), F.lit(source).alias("id"))
    listed = F.lit(None).cast("array<string>")
    audit = audit_rows(ids.where("n > 0"), "entity", "id", {"experience_ids": listed}, {"experience_ids": listed, "split_into": F.lit(target["id"]), "moved": F.col("n")}, F.lit("split"), now, by)
    return Change({"entities": entities, "mentions": after_mentions, "claims": after_claims}, audit)


def edit_decisions(edits: DataFrame, experiences: DataFrame) -> DataFrame:
    """edits (id, new_content, new_embedding) -> similarity and decision.

    metadata_only without new text, in_place above the bar, else superseded; an unknown similarity supersedes, by our choice.
    """
    rows = edits.join(experiences.select("id", "content", "embedding"), "id")
    similarity = 1 - cosine_distance(F.col("embedding"), F.col("new_embedding"))
    same = F.col("new_content").isNull() | (F.col("new_content") == F.col("content"))
    decision = F.when(same, "metadata_only").when(F.coalesce(similarity, F.lit(0.0)) > IN_PLACE, "in_place").otherwise("superseded")
    return rows.select("id", similarity.alias("similarity"), decision.alias("decision"))


def edit_content(experiences: DataFrame, claims: DataFrame, sources: DataFrame, experience, content: str, embedding: list[float] | None, new_id, now: Column, by: str) -> Change:
    """In place if the meaning stays; else a new row takes over, and claims quoted or inferred from the old one are retracted."""
    spark = experiences.sparkSession
    edit = spark.createDataFrame([(experience, content, embedding)], experiences.select("id", F.col("content").alias("new_content"), F.col("embedding").alias("new_embedding")).schema)
    decision = edit_decisions(edit, experiences).first()["decision"]
    me = F.col("id") == experience
    new_text = F.when(me, content).otherwise(F.col("content"))
    new_vector = F.when(me, F.array(*map(F.lit, embedding or [])).cast("array<float>") if embedding is not None else F.lit(None)).otherwise(F.col("embedding"))
    audit = audit_rows(experiences.where(me & F.lit(decision == "in_place")), "experience", "id", {"content": F.col("content")}, {"content": F.lit(content)}, F.lit("edited"), now, by)
    if decision != "superseded":
        return Change({"experiences": experiences.withColumns({"content": new_text, "embedding": new_vector}) if decision == "in_place" else experiences}, audit, {"in_place": int(decision == "in_place")})
    fresh = experiences.where(me).withColumns({"content": F.lit(content), "embedding": F.array(*map(F.lit, embedding or [])).cast("array<float>") if embedding is not None else F.lit(None).cast("array<float>"), "captured_at": now, "superseded_by": F.lit(None).cast(experiences.schema["superseded_by"].dataType), "id": F.lit(new_id)})
    old = experiences.withColumn("superseded_by", F.when(me, F.lit(new_id)).otherwise(F.col("superseded_by")))
    gone = sources.where((F.col("experience_id") == experience) & F.col("support_kind").isin("verbatim", "inferred")).select(F.col("claim_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    marked = claims.join(gone, "id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)) & (F.col("polarity") == "asserted"))
    superseded = audit_rows(experiences.where(me), "experience", "id", {"superseded_by": F.lit(None).cast("string")}, {"superseded_by": F.lit(str(new_id))}, F.lit("content changed"), now, by)
    retracted = audit_rows(marked.where("_gone"), "claim", "id", {"polarity": F.col("polarity")}, {"polarity": F.lit("retracted")}, F.lit("source superseded"), now, by)
    after = marked.withColumn("polarity", F.when(F.col("_gone"), "retracted").otherwise(F.col("polarity"))).select(*claims.columns)
    return Change({"experiences": old.unionByName(fresh), "claims": after}, superseded.unionByName(retracted), {"superseded": 1})


def orphan_claims(claims: DataFrame, sources: DataFrame, experiences: DataFrame, gone: DataFrame) -> DataFrame:
    """Asserted claims of the experiences in ``gone`` (id) that no other live experience supports."""
    here = sources.join(gone.select(F.col("id").alias("experience_id")).distinct(), "experience_id", "left_semi").select("claim_id").distinct()
    others = sources.join(gone.select(F.col("id").alias("experience_id")).distinct(), "experience_id", "left_anti")
    alive = others.join(experiences.where(live()).select(F.col("id").alias("experience_id")), "experience_id", "left_semi").select("claim_id").distinct()
    return claims.where(F.col("polarity") != "retracted").join(here.join(alive, "claim_id", "left_anti").withColumnRenamed("claim_id", "id"), "id", "left_semi")


def soft_delete(experiences: DataFrame, claims: DataFrame, sources: DataFrame, experience, now: Column, by: str) -> Change:
    """Deleted rows keep their first time of deletion; a second call retracts nothing."""
    row = one(experiences, "id", experience)
    me = F.col("id") == experience
    first = row["deleted_at"] is None
    gone = experiences.where(me & F.lit(first)).select("id")
    orphans = orphan_claims(claims, sources, experiences, gone).select("id").withColumn("_gone", F.lit(True))
    marked = claims.join(orphans, "id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    audit = audit_rows(experiences.where(me & F.lit(first)), "experience", "id", {"deleted_at": F.lit(None).cast("string")}, {"deleted_at": now.cast("string")}, F.lit("deleted"), now, by)
    retracted = audit_rows(marked.where("_gone"), "claim", "id", {"polarity": F.col("polarity")}, {"polarity": F.lit("retracted")}, F.lit("only source deleted"), now, by)
    deleted = experiences.withColumn("deleted_at", F.when(me, F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at")))
    after = marked.withColumn("polarity", F.when(F.col("_gone"), "retracted").otherwise(F.col("polarity"))).select(*claims.columns)
    return Change({"experiences": deleted, "claims": after}, audit.unionByName(retracted))


def set_visibility(experiences: DataFrame, experience, visibility: str, viewer: str | None, now: Column, by: str) -> Change:
    if visibility not in ("private", "shared"):
        raise ValueError("visibility is private or shared")
    row = one(experiences, "id", experience)
    if viewer is not None and row["owner"] != viewer:
        raise PermissionError("only the owner may change visibility")
    me = (F.col("id") == experience) & (F.col("visibility") != visibility)
    audit = audit_rows(experiences.where(me), "experience", "id", {"visibility": F.col("visibility")}, {"visibility": F.lit(visibility)}, F.lit("visibility"), now, by)
    return Change({"experiences": experiences.withColumn("visibility", F.when(me, visibility).otherwise(F.col("visibility")))}, audit)


def patched(experiences: DataFrame, experience, changes: dict, now: Column, by: str) -> Change:
    """Set fields; the audit row holds only those that really change."""
    row = one(experiences, "id", experience)
    new = {k: v for k, v in changes.items() if row.get(k) != v}
    me = F.col("id") == experience
    value = lambda k: F.lit(new[k]).cast(experiences.schema[k].dataType)
    audit = audit_rows(experiences.where(me & F.lit(bool(new))), "experience", "id", {k: F.col(k) for k in new} or {"id": F.col("id")}, {k: value(k) for k in new} or {"id": F.col("id")}, F.lit("edited"), now, by)
    return Change({"experiences": experiences.withColumns({k: F.when(me, value(k)).otherwise(F.col(k)) for k in new}) if new else experiences}, audit)


def resolved(rows: DataFrame, key: str, value, status: str, now: Column, allowed: tuple[str, ...]) -> DataFrame:
    """Compare and set: a row that waits gets its outcome; another one raises."""
    if status not in allowed:
        raise ValueError(f"status is one of {allowed}")
    if one(rows, key, value)["status"] != "pending":
        raise ValueError("already resolved")
    me = F.col(key) == value
    return rows.withColumns({"status": F.when(me, status).otherwise(F.col("status")), "resolved_at": F.when(me, now).otherwise(F.col("resolved_at"))})


def match_choice(options: list, choice) -> int:
    """The option that a choice means: its index, its label, or an option with that label; labels are compared as they are."""
    if isinstance(choice, bool):
        raise ValueError("a choice is an index, a label or an option")
    if isinstance(choice, int):
        if not 0 <= choice < len(options):
            raise ValueError("no such option")
        return choice
    label = choice.get("label") if isinstance(choice, dict) else choice
    found = [k for k, option in enumerate(options) if isinstance(label, str) and option.get("label") == label]
    if not found:
        raise ValueError("no such option")
    return found[0]


def claims_to_write(claims: DataFrame, index: DataFrame, concept_scores: DataFrame | None = None, bar: float = 0.85) -> DataFrame:
    """Extracted claims (subject, subject_kind, object, object_kind, ...) with subject_id, object_entity_id and object_literal.

    First-person ends are dropped; names bind by the index; a concept whose best score is below the bar stays a literal.
    """
    from lattica.functions.text import folded, is_first_person

    rows = claims.where(~is_first_person(F.col("subject")) & ~F.coalesce(is_first_person(F.col("object")), F.lit(False)))
    for end, out in (("subject", "subject_id"), ("object", "_object")):
        dim = index.select(F.col("kind").alias(f"{end}_kind"), F.col("norm").alias("_norm"), F.col("entity_id").alias(out))
        rows = rows.withColumn("_norm", folded(F.col(end))).join(dim, [f"{end}_kind", "_norm"], "left").drop("_norm")
    if concept_scores is not None:
        rows = rows.join(concept_scores.select("object", "trgm_score", F.col("entity_id").alias("_scored")), "object", "left")
        near = F.coalesce("trgm_score", F.lit(0.0)) >= bar
        rows = rows.withColumn("_object", F.coalesce("_object", F.when(near, F.col("_scored")))).drop("trgm_score", "_scored")
    return rows.withColumns({"object_entity_id": F.col("_object"), "object_literal": F.when(F.col("_object").isNull(), F.col("object"))}).drop("_object")
