"""The engine's operators on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import names as N
from lattica.functions import text as X
from lattica.functions.predicates import contains, in_bbox, visible
from lattica.operators import dedup, graph, lifecycle, listings, resolve, review, search
from lattica.operators.fusion import fuse
from lattica.sources import durable as store
from lattica.streaming import consolidation, salience

ENTITY = "id string, kind string, canonical_name string, aliases array<string>, merged_into string"
CLAIM = "id long, subject_id string, predicate string, object_entity_id string, object_literal string, polarity string, confidence float, superseded_by long, created_at timestamp"
EXPERIENCE = "id long, captured_at timestamp, occurred_at timestamp, source_kind string, content string, embedding array<float>, metadata string, owner string, visibility string, superseded_by long, deleted_at timestamp, lat double, lng double"
EVENT = "id long, target_kind string, target_id string, before string, after string, reason string, created_at timestamp, created_by string"
T0 = dt.datetime(2024, 1, 10, 12)


def now():
    return F.lit(T0)


def entities(spark, *rows):
    return spark.createDataFrame([(i, k, n, a, m) for i, k, n, a, m in rows], ENTITY)


def people(spark, *ids):
    return entities(spark, *((i, "person", f"name {i}", [], None) for i in ids))


def claims(spark, *edges):
    return spark.createDataFrame([(k, a, "knows", b, None, "asserted", c, None, T0) for k, (a, b, c) in enumerate(edges)], CLAIM)


def experience(i, content="text", owner="a", visibility="private", superseded=None, deleted=None, embedding=None, lat=None, lng=None, metadata="{}", captured=T0):
    return (i, captured, None, "manual", content, embedding, metadata, owner, visibility, superseded, deleted, lat, lng)


def test_relationships_multiply_and_prune(spark):
    e = people(spark, "a", "b", "c")
    c = claims(spark, ("a", "b", 0.8), ("b", "c", 0.5))
    got = {r.entity_id: (r.hops, round(r.confidence, 6)) for r in graph.relationships_to(c, e, "a", 2).collect()}
    assert got == {"b": (1, 0.8), "c": (2, 0.4)}
    assert [r.entity_id for r in graph.relationships_to(c, e, "a", 2, 0.5).collect()] == ["b"]
    with pytest.raises(ValueError, match="max_hops"):
        graph.relationships_to(c, e, "a", 4)


def test_relationships_follow_merges(spark):
    e = entities(spark, ("a", "person", "A", [], None), ("b", "person", "B", [], None), ("b2", "person", "B2", [], "b"), ("c", "person", "C", [], None))
    c = claims(spark, ("a", "b2", 0.9), ("b", "c", 0.9), ("b", "b2", 1.0))
    got = {r.entity_id: r.hops for r in graph.relationships_to(c, e, "a", 2).collect()}
    assert got == {"b": 1, "c": 2}


def test_relationships_match_path_enumeration(spark):
    r = random.Random(3)
    for _ in range(3):
        nodes = [f"n{i}" for i in range(6)]
        edges = [(*r.sample(nodes, 2), round(r.uniform(0.3, 1), 2)) for _ in range(9)]
        best: dict[str, list] = {}
        both = [(a, b, c) for a, b, c in edges] + [(b, a, c) for a, b, c in edges]
        stack = [("n0", ("n0",), 1.0)]
        while stack:
            node, path, conf = stack.pop()
            for a, b, c in both:
                if a == node and b not in path and conf * c >= 0.3 and len(path) <= 3:
                    old = best.get(b, [9, 0.0])
                    best[b] = [min(old[0], len(path)), max(old[1], conf * c)]
                    stack.append((b, (*path, b), conf * c))
        got = {x.entity_id: [x.hops, x.confidence] for x in graph.relationships_to(claims(spark, *edges), people(spark, *nodes), "n0", 3, 0.3).collect()}
        assert got.keys() == best.keys()
        assert all(got[k][0] == best[k][0] and got[k][1] == pytest.approx(best[k][1], rel=1e-5) for k in best)


def test_flatten_chains_and_cycles(spark):
    rows = [(f"e{i}", "person", "x", [], f"e{i + 1}" if i < 20 else None) for i in range(21)]
    change = lifecycle.flatten(entities(spark, *rows), now(), "t")
    assert {r.merged_into for r in change.tables["entities"].where("id <> 'e20'").collect()} == {"e20"}
    assert change.audit.count() == 19
    again = lifecycle.flatten(change.tables["entities"], now(), "t")
    assert again.audit.count() == 0 and graph.chain_violations(again.tables["entities"]).count() == 0
    long = spark.range(1000).selectExpr("concat('e', id) AS id", "'person' AS kind", "'x' AS canonical_name", "array('x') AS aliases", "if(id < 999, concat('e', id + 1), null) AS merged_into")
    assert graph.flatten_chains(long).where("terminal = 'e999'").count() == 999
    with pytest.raises(ValueError, match="cycle"):
        lifecycle.flatten(entities(spark, ("a", "person", "x", [], "b"), ("b", "person", "x", [], "a")), now(), "t")


def test_mentions_of_what_was_merged_over_many_steps(spark):
    e = entities(spark, *((f"e{i}", "person", f"n{i}", ["Ann"] if i == 9 else [], f"e{i + 1}" if i < 9 else None) for i in range(10)), ("x", "person", "x", [], "y"), ("y", "person", "y", [], "x"))
    m = spark.createDataFrame([(k, f"e{k}") for k in range(10)] + [(10, "x")], "experience_id long, entity_id string")
    assert sorted(r.id for r in graph.experience_ids_mentioning("ann ", e, m).collect()) == list(range(10))
    assert [r.id for r in graph.experience_ids_mentioning("y", e, m, "person").collect()] == [10]


def test_split_candidates_count_a_claim_with_itself_once(spark):
    c = claims(spark, *[("a", "a", 1.0)] * 3, *[("a", f"x{i}", 1.0) for i in range(4)])
    got = graph.split_candidates(c, people(spark, "a", *(f"x{i}" for i in range(4)))).collect()
    assert [(r.id, r.degree) for r in got] == [("a", 7)]


LABELLED = [
    ("person", "Ada Lovelace", "person", "ada  lovelace", False), ("person", "Jonathan Smith", "person", "Jonathon Smith", True), ("person", "Karen Hill", "person", "Karen Sommers", False),
    ("person", "Ada", "person", "Ada Lovelace", False), ("person", "John Smith", "person", "John Smith Jr", False), ("org", "Acme", "org", "acme", True), ("org", "Acme", "person", "Acme", False),
    ("concept", "C++", "concept", "C", False), ("person", "Unit 12 Lead", "person", "Unit 13 Lead", False), ("concept", "machine learning", "concept", "Machine  Learning", True),
]


@pytest.mark.parametrize(("ka", "a", "kb", "b", "same"), LABELLED)
def test_match_scores(ka, a, kb, b, same):
    assert (N.match_score(ka, [a], kb, [b]) >= N.AUTO_MERGE) == same


def test_match_probabilities(spark):
    rows = [(f"{side}{k}", kind, name, [], None) for k, (ka, a, kb, b, _) in enumerate(LABELLED) for side, kind, name in (("a", ka, a), ("b", kb, b))]
    pairs = spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(len(LABELLED))], "a string, b string")
    got = {r.a: r.score for r in dedup.scored_pairs(pairs, dedup.named(entities(spark, *rows)), "fs").collect()}
    assert [got[f"a{k}"] >= N.FS_AUTO for k in range(len(LABELLED))] == [x[4] for x in LABELLED]


def test_jaro_known_values():
    assert N.jaro("martha", "marhta") == pytest.approx(0.9444, abs=1e-4)
    assert N.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert N.jaro("abc", "abc") == 1 and N.jaro("abc", "xyz") == 0 and N.jaro("", "a") == 0
    assert N.jaro_winkler("dixon", "xdixon") == N.jaro("dixon", "xdixon")


def test_phonetic_codes():
    assert N.phonetic("Smith") == N.phonetic("Smyth") and N.phonetic("Philip") == N.phonetic("Filip") and N.phonetic("Knight") == N.phonetic("Nite")
    assert N.phonetic("Robert") != N.phonetic("Karen") and N.phonetic("123") == "" and N.phonetic(None) == ""


def test_resolve_exact_alias_first(spark):
    e = entities(spark, ("1", "person", "ZQ", ["Zephyrine", "Quux"], None), ("2", "person", "Zephyrin Quuxe", [], None), ("3", "person", "gone", ["Zephyrine"], "1"))
    got = resolve.resolve_entity(e, "Zephyrine", "person").collect()
    assert got[0].entity_id == "1" and got[0].trgm_score == 1.0 and {r.entity_id for r in got} <= {"1", "2"}
    assert resolve.resolve_entity(e, "Zephyrine Quux", "person").collect()[0].trgm_score == 1.0  # all aliases as one text


def test_resolve_or_create(spark):
    names = spark.createDataFrame([(1, "person", "A"), (2, "person", "B"), (3, "person", "C"), (4, "person", "D")], "query_id long, kind string, name string")
    found = spark.createDataFrame([(1, "e1", 0.9, 1), (2, "e2", 0.7, 1), (3, "e3", 0.7, 1), (4, "e4", 0.5, 1)], "query_id long, entity_id string, trgm_score double, rank long")
    scores = spark.createDataFrame([(2, "e2", 0.95), (3, "e3", 0.86)], "query_id long, entity_id string, verified double")
    got = {r.query_id: (r.action, r.entity_id) for r in resolve.resolve_or_create(names, found, scores).collect()}
    assert got == {1: ("matched", "e1"), 2: ("auto_merged", "e2"), 3: ("provisional", "e3"), 4: ("created", None)}


def test_dedup_plan(spark):
    e = entities(
        spark, ("1", "person", "Jonathan Smith", [], None), ("2", "person", "Jonathon Smith", ["J S"], None), ("3", "person", "Karen Hill", [], None), ("4", "person", "Karen Sommers", [], None),
        ("5", "concept", "graph db", [], None), ("6", "concept", "Graph DB", [], None), ("7", "concept", "graph-db", [], None),
    )
    got = {(r.a, r.b): (r.action, r.winner) for r in dedup.plan(e).collect()}
    assert got[("1", "2")] == ("merge", "2") and got[("3", "4")][0] == "queue"
    assert got[("5", "6")] == ("merge", "5") and got[("5", "7")][0] == "queue"
    held = spark.createDataFrame([("6", "5")], "a string, b string")
    assert ("5", "6") not in {(r.a, r.b) for r in dedup.plan(e, held=held).collect()}
    fs = {(r.a, r.b): r.action for r in dedup.plan(e, scorer="fs").collect()}
    assert fs[("1", "2")] == "merge" and fs[("5", "6")] == "merge"


def test_given_name_of_two_is_queued(spark):
    e = entities(spark, ("1", "person", "Ada", [], None), ("2", "person", "Ada Lovelace", [], None), ("3", "person", "Ada Byron", [], None))
    assert {r.action for r in dedup.plan(e).collect()} == {"queue"}


def test_contested(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("x", "z")], "a string, b string")
    assert [r.id for r in dedup.contested(merges).collect()] == ["b"]
    r = random.Random(8)
    pairs = [tuple(r.sample("abcdefghijkl", 2)) for _ in range(24)] + [("hub", f"h{k}") for k in range(40)]
    near = {x: {q if p == x else p for p, q in pairs if x in (p, q)} for e in pairs for x in e}
    want = {x for x, ps in near.items() if any(q not in near[p] for p in ps for q in ps if p != q)}
    assert {x.id for x in dedup.contested(spark.createDataFrame(pairs, "a string, b string")).collect()} == want


def test_greedy_cap_matches_rounds(spark):
    r = random.Random(5)
    rows = [(round(r.random(), 3), *sorted(r.sample("abcdefgh", 2))) for _ in range(60)]
    rows = list({(a, b): (s, a, b) for s, a, b in rows}.values())
    count, want = dict.fromkeys("abcdefgh", 0), []
    for score, a, b in sorted(rows, key=lambda x: (-x[0], x[1:])):
        if count[a] < 3 and count[b] < 3:
            count[a], count[b] = count[a] + 1, count[b] + 1
            want.append((score, a, b))
    got = dedup.trimmed(spark.createDataFrame([(a, b, s) for s, a, b in rows], "a string, b string, score double"), 3)
    assert sorted((x.score, x.a, x.b) for x in got.collect()) == sorted(want)


def test_merge_and_unmerge(spark):
    e = entities(spark, ("w", "person", "Winner", ["W"], None), ("l", "person", "Loser", ["L", "W"], None), ("o", "person", "Old", [], "l"), ("k", "org", "K", [], None))
    pair = spark.createDataFrame([("l", "w", "pending", None)], "entity_a string, entity_b string, status string, resolved_at timestamp")
    change = lifecycle.merge(e, pair, "l", "w", now(), "t")
    after = {r.id: r for r in change.tables["entities"].collect()}
    assert after["w"].aliases == ["W", "Loser", "L"] and after["l"].merged_into == after["o"].merged_into == "w"
    assert change.tables["candidates"].first().status == "merged" and change.audit.count() == 2
    back = lifecycle.unmerge(change.tables["entities"], change.audit, change.tables["candidates"], "l", now(), "t")
    after = {r.id: r for r in back.tables["entities"].collect()}
    assert after["l"].merged_into is None and after["o"].merged_into == "l" and after["w"].aliases == ["W", "Loser", "L"]
    assert back.tables["candidates"].first().status == "pending"
    for loser, winner in (("l", "l"), ("o", "w"), ("k", "w")):
        with pytest.raises(ValueError):
            lifecycle.merge(e, None, loser, winner, now(), "t")
    with pytest.raises(LookupError):
        lifecycle.merge(e, None, "none", "w", now(), "t")


def test_rename_alias_retract(spark):
    e = entities(spark, ("a", "person", "Old", ["x"], None))
    change = lifecycle.rename(e, "a", "New", now(), "t")
    assert change.tables["entities"].first().aliases == ["x", "Old"] and change.audit.count() == 1
    assert lifecycle.rename(e, "a", "Old", now(), "t").audit.count() == 0
    assert lifecycle.append_alias(e, "a", "x").first().aliases == ["x"] and lifecycle.append_alias(e, "a", "y").first().aliases == ["x", "y"]
    c = claims(spark, ("a", "b", 1.0))
    gone = lifecycle.retract_claim(c, 0, "wrong", now(), "t")
    assert gone.tables["claims"].first().polarity == "retracted" and gone.audit.count() == 1
    with pytest.raises(ValueError, match="reason"):
        lifecycle.retract_claim(c, 0, " ", now(), "t")


SOURCES = "claim_id long, experience_id long, support_kind string"
MENTION = "experience_id long, entity_id string, surface_form string, field string"


def test_split_entity(spark):
    e, c = people(spark, "a", "b"), claims(spark, ("a", "b", 1.0), ("b", "a", 1.0))
    mentions = spark.createDataFrame([(1, "a", "A", "people"), (2, "a", "A", "people")], MENTION)
    sources = spark.createDataFrame([(0, 1, "verbatim"), (1, 2, "verbatim")], SOURCES)
    scope = spark.createDataFrame([(1,)], "id long")
    change = lifecycle.split_entity(e, mentions, c, sources, "a", {"id": "n", "canonical_name": "New"}, scope, now(), "t")
    assert sorted((r.experience_id, r.entity_id) for r in change.tables["mentions"].collect()) == [(1, "n"), (2, "a")]
    assert sorted((r.subject_id, r.object_entity_id) for r in change.tables["claims"].collect()) == [("b", "a"), ("n", "b")]
    assert change.tables["entities"].where("id = 'n'").count() == 1 and change.audit.count() == 1
    none = lifecycle.split_entity(e, mentions, c, sources, "a", {"id": "n"}, scope.where("id > 5"), now(), "t")
    assert none.audit.count() == 0


def test_edit_and_delete(spark):
    x = spark.createDataFrame([experience(1, embedding=[1.0, 0.0]), experience(2, embedding=[0.0, 1.0]), experience(3)], EXPERIENCE)
    c = claims(spark, ("a", "b", 1.0), ("a", "c", 1.0))
    sources = spark.createDataFrame([(0, 1, "verbatim"), (1, 1, "paraphrased"), (1, 2, "verbatim")], SOURCES)
    near = lifecycle.edit_content(x, c, sources, 1, "new", [1.0, 0.01], 9, now(), "t")
    assert near.counts == {"in_place": 1} and near.tables["experiences"].where("id = 1").first().content == "new"
    far = lifecycle.edit_content(x, c, sources, 1, "new", [0.0, 1.0], 9, now(), "t")
    rows = {r.id: r for r in far.tables["experiences"].collect()}
    assert rows[1].superseded_by == 9 and rows[9].content == "new" and rows[9].owner == "a" and rows[9].superseded_by is None
    assert {r.id: r.polarity for r in far.tables["claims"].collect()} == {0: "retracted", 1: "asserted"}
    assert lifecycle.edit_content(x, c, sources, 3, "new", [1.0, 0.0], 9, now(), "t").counts == {"superseded": 1}  # unknown similarity
    gone = lifecycle.soft_delete(x, c, sources, 1, now(), "t")
    assert {r.id: r.polarity for r in gone.tables["claims"].collect()} == {0: "retracted", 1: "asserted"} and gone.audit.count() == 2
    again = lifecycle.soft_delete(gone.tables["experiences"], gone.tables["claims"], sources, 1, now(), "t")
    assert again.audit.count() == 0


def test_visibility_and_patch(spark):
    x = spark.createDataFrame([experience(1)], EXPERIENCE)
    assert lifecycle.set_visibility(x, 1, "shared", "a", now(), "t").tables["experiences"].first().visibility == "shared"
    with pytest.raises(PermissionError):
        lifecycle.set_visibility(x, 1, "shared", "b", now(), "t")
    change = lifecycle.patched(x, 1, {"metadata": '{"a": 1}', "visibility": "private"}, now(), "t")
    assert change.audit.first().after == '{"metadata":"{\\"a\\": 1}"}'


def test_choices_and_resolution(spark):
    options = [{"label": "Yes"}, {"label": "No"}]
    assert lifecycle.match_choice(options, 1) == 1 and lifecycle.match_choice(options, "Yes") == 0 and lifecycle.match_choice(options, {"label": "No"}) == 1
    for bad in (True, 5, -1, "maybe", "yes", {"value": 1}, None):
        with pytest.raises(ValueError):
            lifecycle.match_choice(options, bad)
    rows = spark.createDataFrame([(1, "pending", None), (2, "applied", None)], "id long, status string, resolved_at timestamp")
    assert lifecycle.resolved(rows, "id", 1, "applied", now(), ("applied", "rejected")).where("id = 1").first().status == "applied"
    with pytest.raises(ValueError, match="already"):
        lifecycle.resolved(rows, "id", 2, "applied", now(), ("applied", "rejected"))


def test_review_gate(spark):
    e = entities(spark, ("a", "concept", "A", [], None), ("b", "concept", "B", [], None), ("c", "person", "C", [], None))
    cand = spark.createDataFrame([(1, "a", "b", 0.9, "pending", T0), (2, "a", "c", 0.8, "pending", T0)], "id long, entity_a string, entity_b string, similarity double, status string, created_at timestamp")
    none = spark.createDataFrame([], MENTION)
    shown, deferred = review.merge_queue(cand, e, claims(spark, ("x", "y", 1.0)), none)
    assert [r.id for r in shown.collect()] == [2] and deferred.first().deferred == 1
    shown, deferred = review.merge_queue(cand, e, claims(spark, ("a", "y", 1.0)), none)
    assert [r.id for r in shown.collect()] == [1, 2] and deferred.first().deferred == 0


@pytest.mark.parametrize(
    ("kind", "before", "after", "want"),
    [
        ("claim", "{}", "{}", "retract"), ("entity", '{"merged_into":null,"canonical_name":"a"}', '{"merged_into":"x"}', "merge"), ("entity", '{"merged_into":"x"}', '{"merged_into":null}', "unmerge"),
        ("entity", "{}", '{"experience_ids":[1]}', "split"), ("entity", '{"canonical_name":"a"}', '{"canonical_name":"b"}', "rename"), ("entity", "{}", '{"experience_id":1}', "edit"),
        ("experience", "{}", '{"deleted_at":"x"}', "delete"), ("experience", "{}", '{"superseded_by":"x"}', "supersede"), ("experience", "{}", '{"visibility":"shared"}', "visibility"),
        ("experience", "{}", '{"visibility":"shared","content":"x"}', "edit"), ("experience", None, None, "edit"),
    ],
)
def test_change_types(spark, kind, before, after, want):
    df = spark.createDataFrame([(kind, before, after)], "k string, b string, a string")
    assert df.select(X.change_type(F.col("k"), F.col("b"), F.col("a")).alias("x")).first().x == want


def test_activity(spark):
    events = spark.createDataFrame([(1, "entity", "l", '{"merged_into":null}', '{"merged_into":"w"}', "r", T0, "mcp:x"), (2, "claim", "0", "{}", "{}", "r", T0, "consolidation")], EVENT)
    x = spark.createDataFrame([experience(1)], EXPERIENCE)
    got = {r.id: r for r in review.activity(events, x, people(spark, "l", "w"), claims(spark, ("l", "w", 1.0))).collect()}
    assert (got[1].change_type, got[1].actor, got[1].entity_name, got[1].winner_name) == ("merge", "human", "name l", "name w")
    assert (got[2].change_type, got[2].actor, got[2].claim_predicate) == ("retract", "auto", "knows")


def test_boxes(spark):
    x = spark.createDataFrame([experience(1, lat=0.0, lng=0.0), experience(2, lat=10.0, lng=175.0), experience(3, lat=10.0, lng=-175.0), experience(4)], EXPERIENCE)
    ids = lambda *box: sorted(r.id for r in x.where(in_bbox(*box)).collect())
    assert ids(-1.0, -1.0, 1.0, 1.0) == [1] and ids(0.0, 170.0, 20.0, -170.0) == [2, 3]


def test_visibility_predicate(spark):
    x = spark.createDataFrame([experience(1, owner="a"), experience(2, owner="b"), experience(3, owner=None, visibility="shared"), experience(4, owner=None)], EXPERIENCE)
    assert sorted(r.id for r in x.where(visible("a")).collect()) == [1, 3] and x.where(visible(None)).count() == 4


def test_json_containment(spark):
    docs = ['{"type":"note","topics":["a","b"],"n":1,"in":{"x":true}}', '{"type":"task"}', None, "{}"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, m string")
    hits = lambda w: sorted(r.id for r in df.where(contains("m", w)).collect())
    assert hits({"type": "note"}) == [0] and hits({"topics": ["b"]}) == [0] and hits({"topics": ["b", "z"]}) == []
    assert hits({"in": {"x": True}, "n": 1}) == [0] and hits({}) == [0, 1, 3]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2)], "id long, score double, rank int")
    b = spark.createDataFrame([(2, 5.0, 1)], "id long, score double, rank int")
    got = {r.id: (r.x, r.y, r.fused_score) for r in fuse({"x": a, "y": b}, "id").collect()}
    assert got[1] == (0.9, 0.0, pytest.approx(1 / 61)) and got[2] == (0.8, 5.0, pytest.approx(1 / 62 + 1 / 61))


def test_hybrid_filters(spark):
    v = [1.0, 0.0]
    x = spark.createDataFrame([experience(1, "red fox", embedding=v), experience(2, "red fox", deleted=T0, embedding=v), experience(3, "blue", owner="b", embedding=v), experience(4, "red", embedding=[-1.0, 0.0])], EXPERIENCE)
    got = {r.id: r for r in search.hybrid(x, "fox red", v, viewer="a").collect()}
    assert set(got) == {1} and got[1].fused_score == pytest.approx(2 / 61)
    assert {r.id for r in search.hybrid(x, "", v).collect()} == {1, 3} and search.hybrid(x, "", None).count() == 0


def test_paging(spark):
    rows, more, after = listings.page_with_more(spark.range(5).orderBy("id"), 2, 2)
    assert [r.id for r in rows] == [2, 3] and more and after == 4
    assert listings.page_with_more(spark.range(5).orderBy("id"), 2, 4)[1:] == (False, None)


@pytest.mark.parametrize(("text", "query", "want"), [("a <b>", "", "a &lt;b&gt;"), ("One two", "TWO", "One <mark>two</mark>"), ("x" * 300, "zz", "x" * 200 + "…"), ("a" * 150 + "HIT" + "b" * 150, "hit", "…" + "a" * 98 + "<mark>HIT</mark>" + "b" * 98 + "…")])
def test_excerpts(spark, text, query, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.excerpt(F.col("t"), query).alias("x")).first().x == want


def test_recency_and_buckets(spark):
    times = [T0 + dt.timedelta(hours=1), T0 - dt.timedelta(seconds=59), T0 - dt.timedelta(minutes=59), T0 - dt.timedelta(hours=23), T0 - dt.timedelta(days=30), None]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    assert [r.x for r in df.select(X.recency(F.col("t"), now()).alias("x")).collect()][:5] == ["now", "now", "59m", "23h", "30d"]
    days = [T0, T0 - dt.timedelta(days=1), T0 - dt.timedelta(days=2), T0 - dt.timedelta(days=3), None]
    df = spark.createDataFrame([(t,) for t in days], "t timestamp")
    assert [r.x for r in df.select(X.day_bucket(F.col("t"), now()).alias("x")).collect()] == ["today", "yesterday", "this-week", "earlier", "earlier"]


def test_first_person(spark):
    df = spark.createDataFrame([("I",), (" 'We'! ",), ("my team",), (None,)], "s string")
    assert [r.x for r in df.select(X.is_first_person(F.col("s")).alias("x")).collect()] == [True, True, False, False]


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "x long, y string")
    assert store.append_if_absent(rows, path, ["x", "y"]).count() == 2
    assert store.append_if_absent(rows, path, ["x", "y"]).count() == 0 and spark.read.parquet(path).count() == 2
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c")], "entity_a string, entity_b string")
    assert [tuple(r) for r in store.canonical_pairs(pairs).collect()] == [("a", "b")]
    old, new = spark.createDataFrame([("k", None), ("o", "1")], "k string, v string"), spark.createDataFrame([("k", "2"), ("n", "3"), ("o", "9")], "k string, v string")
    assert sorted(tuple(r) for r in store.upsert_coalesce(old, new, "k").collect()) == [("k", "2"), ("n", "3"), ("o", "1")]
    assert {r.table: r.rows for r in store.snapshot({"t": rows}, str(tmp_path / "s")).collect()} == {"t": 3}


QUEUE = "id long, status string, attempts int, attempted_at timestamp, captured_at timestamp"


def test_work_queue(spark):
    ago = lambda m: T0 - dt.timedelta(minutes=m)
    rows = [(1, "pending", 0, None, T0), (2, "pending", 1, ago(4), T0), (3, "pending", 1, ago(6), T0), (4, "pending", 2, ago(6), T0), (5, "pending", 3, ago(99), T0), (6, "in_progress", 1, ago(16), T0), (7, "in_progress", 1, ago(3), T0)]
    q = consolidation.reclaimed(spark.createDataFrame(rows, QUEUE), now())
    batch = consolidation.picked(q, now())
    assert [r.id for r in batch.collect()] == [1, 6, 3]
    running = consolidation.started(q, batch, now())
    ended = consolidation.finished(running, spark.createDataFrame([(1, True), (3, False), (6, False), (2, True)], "id long, ok boolean"))
    state = {r.id: (r.status, r.attempts) for r in consolidation.exhausted(ended).collect()}
    assert state == {1: ("complete", 1), 2: ("pending", 1), 3: ("pending", 2), 4: ("pending", 2), 5: ("failed", 3), 6: ("pending", 1), 7: ("in_progress", 1)}


def test_claim_parsing(spark):
    ok = '{"subject":"Ada","subject_kind":"person","predicate":"knows","object":"Bob","object_kind":"person","support_kind":"verbatim","confidence":0.5}'
    bad = [ok.replace("knows", "hates"), ok.replace("knows", "other"), ok.replace("0.5", "1.5"), ok.replace('"Ada"', '" "'), ok.replace("verbatim", "guess")]
    raw = spark.createDataFrame([(1, f"[{','.join([ok, *bad])}]"), (2, "not json")], "id long, payload string")
    good, rejected = consolidation.parsed_claims(raw)
    assert [r.subject for r in good.collect()] == ["Ada"] and rejected.count() == 6


def test_consolidation_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "Ada"), (2, "Bob"), (2, "Bob")], "id long, content string")
    df.write.parquet(src)
    payload = F.concat(F.lit('[{"subject":"'), "content", F.lit('","subject_kind":"person","predicate":"knows","object":"x","object_kind":"person","support_kind":"verbatim","confidence":1}]'))
    extract = lambda rows: rows.select("id", payload.alias("payload"))
    for _ in range(2):  # the second run finds nothing new
        consolidation.consolidate_stream(spark, src, df.schema, extract, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.subject for r in spark.read.parquet(str(tmp_path / "out/claims")).collect()) == ["Ada", "Bob"]


def test_streaming_salience(spark, tmp_path):
    rows = [(k, "claim", k % 2, T0 - dt.timedelta(days=k), ["helpful", "wrong", None][k % 3]) for k in range(12)]
    df = spark.createDataFrame(rows, "id long, target_kind string, target_id long, recalled_at timestamp, outcome string")
    src = str(tmp_path / "ev")
    df.write.parquet(src)
    stream = salience.windowed(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sal").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.target_id: r.salience for r in salience.from_windows(salience.windowed(df), now()).collect()}
    got = {r.target_id: r.salience for r in salience.from_windows(spark.table("sal"), now()).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


