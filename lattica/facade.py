"""One object over a set of tables, with a method for each tool of the memory store."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.lexical import lexical_channel
from lattica.functions.parsing import hashing_embedder, participants
from lattica.operators import aggregates, dedup, flows, graph, lifecycle, listings, resolve, review, search
from lattica.sources.durable import durable

#: Defaults and bounds of the tools.
LIMIT, RECALL_DAYS, RECALL_LIMIT, TOP_K, HOPS, FLOOR = 10, 7, 20, 5, 2, 0.6


@dataclass
class MemoryGraph:
    """``tables``: experiences, entities, mentions, claims, sources and, where they are used, candidates, events, disambiguations, corrections.

    Writing tools return a ``Change``; ``apply`` makes its tables current and appends its audit rows.
    """

    tables: dict[str, DataFrame]
    embed: Callable[[str], Sequence[float]] = field(default_factory=hashing_embedder)
    now: Callable[[], Column] = F.current_timestamp
    viewer: str | None = None
    actor: str = "lattica"
    new_id: Callable[[], str] = field(default=lambda: uuid.uuid4().hex)
    extract: Callable[[str], dict] | None = None

    def t(self, name: str) -> DataFrame:
        return self.tables[name]

    def apply(self, change: lifecycle.Change) -> None:
        self.tables |= change.tables
        if "events" in self.tables:
            self.tables["events"] = self.tables["events"].unionByName(change.audit, allowMissingColumns=True)

    def search_thoughts(self, query: str, limit: int = LIMIT, threshold: float = 0.0, filter: dict | None = None, person: str | None = None, topic: str | None = None, provenance: bool = False, min_confidence: float | None = None) -> DataFrame:
        ids = None
        for name, kind in ((person, "person"), (topic, "concept")):
            if name:
                found = graph.experience_ids_mentioning(name, self.t("entities"), self.t("mentions"), kind)
                ids = found if ids is None else ids.join(found, "id", "left_semi")
        hits = search.hybrid(self.t("experiences"), query, list(self.embed(query)) if query.strip() else None, limit, filter, threshold, ids, self.viewer, lexical_channel)
        if not provenance:
            return hits
        block = search.provenance_block(search.provenance(self.t("claims"), self.t("sources"), hits, min_confidence))
        return hits.join(block.withColumnRenamed("experience_id", "id"), "id", "left")

    def search_experiences(self, query: str, limit: int = LIMIT) -> DataFrame:
        return search.tagged(self.search_thoughts(query, limit), self.t("mentions"), self.t("entities"), self.t("sources"))

    def match_thoughts(self, query: str, threshold: float, limit: int = LIMIT, filter: dict | None = None) -> DataFrame:
        return search.by_similarity(self.t("experiences"), list(self.embed(query)), threshold, limit, filter)

    def list_thoughts(self, **options) -> DataFrame:
        return listings.list_thoughts(self.t("experiences"), self.now(), self.viewer, **options)

    def thought_stats(self) -> dict[str, DataFrame]:
        seen = self.t("experiences").where(search.visible(self.viewer))
        total = seen.agg(F.count("*").alias("total"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last"))
        typed = seen.select("*", F.get_json_object("metadata", "$.type").alias("type"), *(F.from_json(F.get_json_object("metadata", f"$.{k}"), "array<string>").alias(k) for k in ("topics", "people")))
        order = [-F.unix_micros(F.col("captured_at").cast("timestamp")), F.col("id")]
        top = lambda k: aggregates.top_in_first_seen_order(typed.select("id", "captured_at", F.explode(k).alias("name")), "name", order)
        return {"total": total, "types": typed.groupBy("type").count(), "top_topics": top("topics"), "top_people": top("people")}

    def get_experience(self, experience) -> dict[str, DataFrame]:
        return listings.experience_detail(experience, *(self.t(n) for n in ("experiences", "mentions", "entities", "claims", "sources")), self.viewer)

    def get_entity(self, entity: str) -> dict[str, DataFrame]:
        return listings.entity_detail(entity, *(self.t(n) for n in ("entities", "claims", "sources", "mentions", "experiences")), self.viewer)

    def recall_recent(self, days: int = RECALL_DAYS, source_kind: str | None = None, query: str | None = None, limit: int = RECALL_LIMIT) -> DataFrame:
        return search.recall_recent(self.t("experiences"), self.now(), days, self.viewer, source_kind, query, list(self.embed(query)) if query else None, min(max(limit, 1), 100), lexical=lexical_channel)

    def who_was_at(self, experience=None, day: str | None = None) -> DataFrame:
        return graph.who_was_at(self.t("experiences"), self.t("mentions"), self.t("entities"), experience, F.lit(day).cast("date") if day else None)

    def relationships_to(self, entity: str, max_hops: int = HOPS, min_confidence: float = FLOOR) -> DataFrame:
        return graph.relationships_to(self.t("claims"), self.t("entities"), entity, max_hops, min_confidence)

    def resolve_entity(self, name: str, kind: str, context: str | None = None, top_k: int = TOP_K) -> DataFrame:
        out = resolve.resolve_entity(self.t("entities"), name, kind, list(self.embed(context or name)) if "embedding" in self.t("entities").columns else None, min(max(top_k, 1), 20))
        best = out.agg(F.max("trgm_score").alias("best"))
        return out.join(best).withColumn("recommendation", resolve.recommendation(F.coalesce("best", F.lit(0.0)))).drop("best")

    def review_queue(self, kind: str) -> DataFrame:
        return review.queue(kind, self.tables)

    def pending_reviews(self) -> DataFrame:
        return review.pending_counts(*(self.t(n) for n in ("candidates", "claims", "sources", "disambiguations", "corrections")))

    def summary(self) -> dict[str, DataFrame]:
        topics = F.from_json(F.get_json_object("metadata", "$.topics"), "array<string>")
        return {"counts": aggregates.summary(self.t("experiences"), self.t("entities"), self.t("claims")), "top_entities": aggregates.top_entities(self.t("mentions"), self.t("entities")), "top_topics": aggregates.top_topics(self.t("experiences"), topics)}

    def recent_feed(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return listings.recent_feed(self.t("experiences"), self.t("mentions"), self.t("entities"), self.viewer, min(limit, 100), offset)

    def experiences_in_bbox(self, min_lat: float, min_lng: float, max_lat: float, max_lng: float) -> DataFrame:
        return listings.in_box(self.t("experiences"), (min_lat, min_lng, max_lat, max_lng), self.viewer)

    def recently_active_entities(self, days: int = 30) -> DataFrame:
        return listings.with_recency(aggregates.recently_active(self.t("mentions"), self.t("experiences"), self.t("entities"), self.now(), days, self.viewer), "last_seen", self.now())

    def recent_entities(self, days: int) -> DataFrame:
        return listings.recent_entities(self.t("entities"), self.now(), days)

    def activity(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return review.activity(self.t("events"), self.t("experiences"), self.t("entities"), self.t("claims"), limit, offset)

    def plan_dedup(self, scorer: str = "default") -> DataFrame:
        held = dedup.held_pairs(self.t("candidates"), self.t("entities")) if "candidates" in self.tables else None
        return dedup.plan(self.t("entities"), scorer, held=held)

    def merge_entities(self, loser: str, winner: str, reason: str = "") -> lifecycle.Change:
        return lifecycle.merge(self.t("entities"), self.tables.get("candidates"), loser, winner, self.now(), self.actor, reason)

    def unmerge_entity(self, entity: str) -> lifecycle.Change:
        return lifecycle.unmerge(self.t("entities"), self.t("events"), self.tables.get("candidates"), entity, self.now(), self.actor)

    def rename_entity(self, entity: str, name: str) -> lifecycle.Change:
        return lifecycle.rename(self.t("entities"), entity, name, self.now(), self.actor)

    def split_entity(self, entity: str, target: dict, experience_ids: DataFrame) -> lifecycle.Change:
        return lifecycle.split_entity(*(self.t(n) for n in ("entities", "mentions", "claims", "sources")), entity, target, experience_ids, self.now(), self.actor)

    def retract_claim(self, claim, reason: str) -> lifecycle.Change:
        return lifecycle.retract_claim(self.t("claims"), claim, reason, self.now(), self.actor)

    def update_experience(self, experience, new_id, content: str) -> lifecycle.Change:
        return lifecycle.edit_content(self.t("experiences"), self.t("claims"), self.t("sources"), experience, content, list(self.embed(content)), new_id, self.now(), self.actor)

    def delete_experience(self, experience) -> lifecycle.Change:
        return lifecycle.soft_delete(self.t("experiences"), self.t("claims"), self.t("sources"), experience, self.now(), self.actor)

    def set_visibility(self, experience, visibility: str) -> lifecycle.Change:
        return lifecycle.set_visibility(self.t("experiences"), experience, visibility, self.viewer, self.now(), self.actor)

    def capture_thought(self, experience, content: str, **options) -> lifecycle.Change:
        """``options``: what :func:`lattica.operators.flows.capture` takes; participants may be text."""
        if "participants" in options:
            options["participants"] = participants(options["participants"])
        return flows.capture(self.tables, experience, content, list(self.embed(content)), self.now(), self.new_id, self.viewer, client=self.actor, extract=self.extract, **options)

    def upsert_thought(self, experience, content: str, metadata: dict) -> DataFrame:
        self.tables["experiences"], row = flows.upsert_thought(self.t("experiences"), experience, content, metadata, list(self.embed(content)), self.now())
        return row

    def propose_correction(self, id, target_kind: str, target_id: str, change: dict, reason: str | None = None) -> None:
        self.tables["corrections"] = flows.propose_correction(self.t("corrections"), id, target_kind, target_id, change, reason)

    def resolve_correction(self, id, decision: str, reason: str | None = None) -> lifecycle.Change:
        return flows.resolve_correction(self.tables, id, decision, self.new_id(), self.now(), self.actor, reason)

    def resolve_merge_candidate(self, id, decision: str, winner: str | None = None, reason: str = "") -> lifecycle.Change:
        return flows.resolve_merge_candidate(self.t("entities"), self.t("candidates"), id, decision, winner, self.now(), self.actor, reason)

    def request_disambiguation(self, question: str, options: list[dict], context: dict | None = None) -> str:
        token = self.new_id()
        self.tables["disambiguations"] = flows.request_disambiguation(self.t("disambiguations"), token, question, options, context)
        return token

    def resolve_disambiguation(self, token: str, choice) -> lifecycle.Change:
        return flows.resolve_disambiguation(self.tables, token, choice, self.new_id(), self.now(), self.actor)

    def split_mention(self, entity: str, target: dict, experience, surface: str, field: str = "people", reason: str = "") -> lifecycle.Change:
        return flows.split_mention(self.t("entities"), self.t("mentions"), entity, target, experience, surface, field, reason, self.now(), self.actor)

    def split_claims(self, entity: str, target: dict, experience, reason: str = "") -> lifecycle.Change:
        return flows.split_claims(*(self.t(n) for n in ("entities", "claims", "sources")), entity, target, experience, reason, self.now(), self.actor)

    def dedup_entities(self, apply: bool = False, kind: str | None = None, scorer: str = "default") -> tuple[DataFrame, lifecycle.Change | None]:
        """The plan's counts by kind and action and, to be applied, its change."""
        held = dedup.held_pairs(self.t("candidates"), self.t("entities"))
        some = self.t("entities").where(F.col("kind") == kind) if kind else self.t("entities")
        plan = durable(dedup.plan(some, scorer, held=held), "dedup-plan")
        change = flows.apply_dedup(self.t("entities"), self.t("candidates"), plan, self.now(), self.actor) if apply else None
        return flows.dedup_counts(plan, self.t("entities")), change
