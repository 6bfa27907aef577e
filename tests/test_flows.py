"""Flows over several tables: captures, corrections, disambiguations, batch merging, materialised views and fixtures."""

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from lattica.facade import MemoryGraph
from lattica.functions import parsing
from lattica.operators import flows, lifecycle, listings, review
from lattica.sources import durable as store

T0 = dt.datetime(2024, 1, 10, 12)
SCHEMAS = {
    "experiences": "id long, captured_at timestamp, occurred_at timestamp, source_kind string, source_ref string, content string, embedding array<float>, metadata string, owner string, visibility string, superseded_by long, deleted_at timestamp, lat double, lng double",
    "entities": "id string, kind string, canonical_name string, aliases array<string>, merged_into string",
    "mentions": "experience_id long, entity_id string, surface_form string, field string",
    "claims": "id long, subject_id string, predicate string, object_entity_id string, object_literal string, polarity string, confidence float, superseded_by long, created_at timestamp",
    "sources": "claim_id long, experience_id long, support_kind string",
    "candidates": "id long, entity_a string, entity_b string, similarity double, status string, created_at timestamp, resolved_at timestamp",
    "events": "id long, target_kind string, target_id string, before string, after string, reason string, created_at timestamp, created_by string",
    "disambiguations": "token string, question string, options string, context string, status string, resolved_choice string, resolved_at timestamp",
    "corrections": "id long, target_kind string, target_id string, suggested_change string, reason string, status string, resolved_at timestamp",
}
ROWS = {
    "experiences": [(k, T0, None, "manual", None, f"text {k}", None, "{}", "a", "private", None, None, None, None) for k in (1, 2)],
    "entities": [("p1", "person", "Jonathan Smith", [], None), ("p2", "person", "Karen Hill", ["Kaz"], None), ("p3", "person", "Gone", [], "p2"), ("c1", "concept", "graph db", [], None), ("c2", "concept", "Graph DB", ["gdb"], None)],
    "mentions": [(1, "p1", "Jon", "people"), (1, "p1", "J.", "people"), (2, "p1", "Jon", "people")],
    "claims": [(10, "p1", "knows", "p2", None, "asserted", 1.0, None, T0), (11, "p2", "knows", "p1", None, "asserted", 1.0, None, T0), (12, "p1", "likes", None, "tea", "retracted", 1.0, None, T0)],
    "sources": [(10, 1, "paraphrased"), (11, 2, "verbatim"), (12, 1, "paraphrased")],
    "candidates": [(1, "p1", "p2", 0.7, "pending", None, None)],
}


@pytest.fixture
def graph(spark):
    ids = itertools.count()
    tables = {name: spark.createDataFrame(ROWS.get(name, []), schema) for name, schema in SCHEMAS.items()}
    return MemoryGraph(tables, now=lambda: F.lit(T0), viewer="a", actor="t", new_id=lambda: f"new{next(ids)}", extract=lambda text: {"topics": [text.split()[0]]})


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bare_capture_extracts_metadata(graph):
    change = graph.capture_thought(9, "hello there", visibility="shared", lat=1.0, lng=2.0)
    row = change.tables["experiences"].where("id = 9").first()
    assert json.loads(row.metadata) == {"topics": ["hello"], "source": "t"} and row.captured_at == T0 and row.owner == "a" and row.visibility == "shared" and len(row.embedding) == 64
    assert set(change.tables) == {"experiences"} and row.source_kind == "manual" and change.counts == {}
    with pytest.raises(ValueError, match="content"):
        graph.capture_thought(9, "  ")


def test_structured_capture_binds_participants(graph):
    people = [{"name": "Karen Hill"}, {"name": "Jonathon Smith"}, {"name": "Karen Hills Lee"}, {"name": "Zed Quux"}, {"name": "p", "entity_id": "p2"}, {"name": " "}]
    change = graph.capture_thought(9, "met", participants=people[:5], hints=[{"p": 1}], source_kind="transcript")
    assert change.counts == {"matched": 1, "auto_merged": 1, "provisional": 1, "created": 1, "provided": 1}
    graph.apply(change)
    bound = {r.surface_form: r.entity_id for r in graph.t("mentions").where("experience_id = 9").collect()}
    assert bound["Karen Hill"] == bound["p"] == bound["Karen Hills Lee"] == "p2" and bound["Jonathon Smith"] == "p1"
    named = {r.id: r for r in graph.t("entities").collect()}
    assert named[bound["Zed Quux"]].canonical_name == "Zed Quux" and "Jonathon Smith" in named["p1"].aliases
    assert graph.t("experiences").where("id = 9").first().source_kind == "transcript" and graph.t("events").count() == 1
    question = graph.t("disambiguations").first()
    assert question.status == "pending" and json.loads(question.context)["provisional_entity_id"] == "p2"
    with pytest.raises(ValueError, match="merged"):
        graph.capture_thought(10, "x", participants=[{"name": "g", "entity_id": "p3"}])
    with pytest.raises(ValueError, match="name"):
        graph.capture_thought(10, "x", participants=people)

    graph.apply(graph.resolve_disambiguation(question.token, 1))
    moved = graph.t("mentions").where("surface_form = 'Karen Hills Lee'").first().entity_id
    assert moved not in ("p1", "p2") and graph.t("entities").where(F.col("id") == moved).first().canonical_name == "Karen Hills Lee"
    assert graph.t("mentions").where("surface_form = 'Karen Hill'").first().entity_id == "p2"
    with pytest.raises(ValueError, match="already"):
        graph.resolve_disambiguation(question.token, 0)


def test_confirming_a_binding_adds_the_alias(graph):
    token = graph.request_disambiguation("same?", [{"label": "Y", "value": {"action": "confirm"}}, {"label": "N", "value": {"action": "reject"}}], {"kind": flows.PROVISIONAL, "provisional_entity_id": "p2", "surface": "Kay", "experience_id": 1, "entity_kind": "person", "field": "people", "source": flows.FROM_CLAIM})
    yes = graph.resolve_disambiguation(token, "Y")
    assert yes.tables["entities"].where("id = 'p2'").first().aliases == ["Kaz", "Kay"] and yes.audit.count() == 0
    no = graph.resolve_disambiguation(token, {"label": "N"})
    assert rows(no.tables["claims"], "id", "subject_id", "object_entity_id")[0] == (10, "p1", no.tables["entities"].where("canonical_name = 'Kay'").first().id) and no.counts == {"claims": 1}
    with pytest.raises(ValueError):
        graph.resolve_disambiguation(token, "Maybe")
    with pytest.raises(ValueError, match="two options"):
        graph.request_disambiguation("same?", [{"label": "Y"}])
    plain = graph.request_disambiguation("which?", [{"label": "1"}, {"label": "2"}])
    done = graph.resolve_disambiguation(plain, 0).tables
    assert set(done) == {"disambiguations"} and json.loads(done["disambiguations"].where(F.col("token") == plain).first().resolved_choice) == {"label": "1"}


def test_split_mention_and_claims(graph):
    change = graph.split_mention("p1", {"id": "n1", "canonical_name": "Jon Other"}, 1, "Jon")
    assert rows(change.tables["mentions"], "experience_id", "entity_id", "surface_form") == [(1, "n1", "Jon"), (1, "p1", "J."), (2, "p1", "Jon")]
    assert change.audit.count() == 1 and change.tables["entities"].where("id = 'n1'").first().kind == "person"
    assert graph.split_mention("p1", {"id": "p2"}, 7, "Jon").audit.count() == 0
    change = graph.split_claims("p1", {"id": "p2"}, 2)
    assert rows(change.tables["claims"], "id", "subject_id", "object_entity_id")[1] == (11, "p2", "p2") and change.tables["entities"].count() == 5
    with pytest.raises(ValueError, match="name"):
        graph.split_claims("p1", {"id": "n2"}, 2)


def test_corrections(graph):
    asked = [("rename", {"new_canonical_name": "Jo"}), ("retract", {"claim_id": "10"}), ("repoint_participant", {"current_entity_id": "p1", "new_entity": {"canonical_name": "N"}, "experience_ids": [1]}), ("rename", {}), ("burn", {})]
    for k, (action, change) in enumerate(asked):
        graph.propose_correction(k, "entity", "p1", {"action": action, **change}, "why")
    assert graph.resolve_correction(0, "apply").tables["entities"].where("id = 'p1'").first().canonical_name == "Jo"
    assert graph.resolve_correction(1, "apply").tables["claims"].where("id = 10").first().polarity == "retracted"
    split = graph.resolve_correction(2, "apply").tables
    assert split["mentions"].where("entity_id <> 'p1'").count() == 2 and split["entities"].where("canonical_name = 'N'").count() == 1
    for bad in (3, 4):
        with pytest.raises(ValueError):
            graph.resolve_correction(bad, "apply")
    graph.apply(graph.resolve_correction(3, "reject"))
    assert rows(graph.t("corrections"), "id", "status")[2:] == [(2, "pending"), (3, "rejected"), (4, "pending")]
    with pytest.raises(ValueError, match="already"):
        graph.resolve_correction(3, "apply")


def test_merge_candidates(graph):
    apart = graph.resolve_merge_candidate(1, "reject")
    assert apart.tables["candidates"].first().status == "kept_separate" and apart.audit.count() == 0
    merged = graph.resolve_merge_candidate(1, "confirm", "p1")
    assert merged.tables["entities"].where("id = 'p2'").first().merged_into == "p1" and merged.tables["candidates"].first().status == "merged"
    with pytest.raises(ValueError, match="pair"):
        graph.resolve_merge_candidate(1, "confirm", "p3")


def test_unmerge_reopens_the_pair_that_was_judged(spark):
    e = spark.createDataFrame([(i, "person", i, [], None) for i in "abcd"], SCHEMAS["entities"])
    pairs = spark.createDataFrame([(1, "a", "b", 0.9, "pending", None, None), (2, "b", "c", 0.9, "pending", None, None), (3, "c", "d", 0.9, "pending", None, None)], SCHEMAS["candidates"])
    events = spark.createDataFrame([], SCHEMAS["events"])
    for k, (loser, winner) in enumerate(("ab", "bc", "cd")):
        change = lifecycle.merge(e, pairs, loser, winner, F.lit(T0 + dt.timedelta(hours=k)), "t")
        e, pairs, events = change.tables["entities"], change.tables["candidates"], events.unionByName(change.audit, allowMissingColumns=True)
    back = lifecycle.unmerge(e, events, pairs, "a", F.lit(T0), "t")
    assert rows(back.tables["candidates"], "id", "status") == [(1, "pending"), (2, "merged"), (3, "merged")]
    assert rows(back.tables["entities"], "id", F.coalesce("merged_into", F.lit("-"))) == [("a", "-"), ("b", "d"), ("c", "d"), ("d", "-")]


def test_dedup_is_applied_at_once(graph, spark):
    more = [("c3", "concept", "graph-db", [], "c1"), ("c4", "concept", "GRAPH DB", ["x"], None), ("p4", "person", "Karen Sommers", [], None)]
    graph.tables["entities"] = graph.t("entities").unionByName(spark.createDataFrame(more, SCHEMAS["entities"]))
    report, nothing = graph.dedup_entities()
    assert nothing is None and rows(report, "kind", "action", "n") == [("concept", "merge", 3), ("person", "queue", 1)]
    _, change = graph.dedup_entities(apply=True)
    after = {r.id: r for r in change.tables["entities"].collect()}
    assert {i: after[i].merged_into for i in ("c1", "c2", "c3", "c4")} == {"c1": "c2", "c2": None, "c3": "c2", "c4": "c2"}
    assert after["c2"].aliases == ["gdb", "graph db", "GRAPH DB", "x"] and change.audit.count() == 3
    assert rows(change.tables["candidates"], "entity_a", "entity_b", "status") == [("p1", "p2", "pending"), ("p2", "p4", "pending")]
    graph.apply(change)
    again = graph.dedup_entities(apply=True, kind="concept")[1]
    assert again.audit.count() == 0 and again.tables["candidates"].count() == 2


def test_views_paging_and_fixtures(graph, spark, tmp_path):
    graph.t("experiences").transform(listings.thoughts).createOrReplaceTempView("thoughts")
    assert spark.sql("SELECT count(*) AS n FROM thoughts WHERE created_at IS NOT NULL").first().n == 2
    page, total, more = listings.counted_page(graph.t("mentions").orderBy("experience_id", "surface_form"), 2)
    assert page.count() == 2 and total == 3 and more and not listings.counted_page(graph.t("mentions"), 2, 2)[2]
    for n in (5, 2):
        held = store.refresh({"counts": spark.range(n).agg(F.count("*").alias("n"))}, f"file://{tmp_path}/summary")
        assert held["counts"].first().n == n == store.refreshed(spark, f"file://{tmp_path}/summary", ["counts"])["counts"].first().n
    fixture = ({"mentions": [{"experience_id": 1, "entity_id": "a", "surface_form": "A", "field": "people"}, {"experience_id": 1, "entity_id": "a"}]}, {"mentions": f"file://{tmp_path}/m"}, SCHEMAS, {"mentions": ["experience_id", "entity_id", "surface_form"]}, spark)
    assert store.seed(*fixture) == {"mentions": 2} and store.seed(*fixture) == {"mentions": 0}
    row = graph.upsert_thought(7, "note", {"k": 1}).first()
    assert row.source_kind == "manual" and row.captured_at == T0 and graph.t("experiences").count() == 3
    assert graph.get_experience(1)["experience"].first().can_change_visibility
    some = graph.t("experiences").select("id")
    assert rows(review.sources_by_kind(graph.t("claims"), graph.t("sources"), some, "paraphrased"), "experience_id", "claim_id") == [(1, 10)]
    assert review.sources_by_kind(graph.t("claims"), graph.t("sources"), some).count() == 2


def test_fields_of_requests():
    assert parsing.listed_strings(' a, b,,"c" ') == ["a", "b", '"c"'] and parsing.listed_strings('[" x ", 3, ""]') == ["x", "3"] and parsing.listed_strings(None) == []
    assert parsing.participants("Ann, Bo") == [{"name": "Ann"}, {"name": "Bo"}] and parsing.participants('[{"name": " Ann ", "r": 1}, "Bo"]') == [{"name": "Ann", "r": 1}, {"name": "Bo"}] and parsing.participants("") is None
    assert parsing.moment(" 2024-01-01T10:00:00+01:00 ") == "2024-01-01T10:00:00+01:00" and parsing.moment("") is None
    assert parsing.location("1", "-2.5") == {"lat": 1.0, "lng": -2.5} and parsing.location("", None) is None
    for bad in (lambda: parsing.participants([{"name": " "}]), lambda: parsing.moment("soon"), lambda: parsing.location("1", ""), lambda: parsing.location("91", "0"), lambda: parsing.location("nan", "0"), lambda: parsing.listed_strings("[1")):
        with pytest.raises(ValueError):
            bad()
