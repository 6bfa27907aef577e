"""Queries and operators that must not leave rows out, against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest

from lattica.functions import names as N
from lattica.operators import blocked, dedup
from lattica.plans import catalogue
from lattica.sources.views import Memory

SF = "/root/testdata/sf0.001"
ENTITY = "id string, kind string, canonical_name string, aliases array<string>, merged_into string"


@pytest.fixture(scope="module")
def memory(spark):
    return Memory(spark, SF)


def named(memory):
    return {r.id: r for r in dedup.named(catalogue.entities(memory)).collect()}


def signed(forms):
    """One signature of the grams of all forms together."""
    grams = {x[i : i + 3] for x in (f" {f} " for f in forms) for i in range(max(1, len(x) - 2))}
    hashed = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams]
    return [min((a * h + b) % ((1 << 61) - 1) for h in hashed) for a, b in dedup.coefficients()]


def candidates(rows, minhash):
    blocks = {}
    for r in rows.values():
        for f in r.forms:
            for key in [t for t in f.split() if len(t) >= 3]:
                blocks.setdefault((r.kind, key), set()).add(r.id)
        if minhash and r.forms:
            s = signed(r.forms)
            for b in range(32):
                blocks.setdefault((r.kind, b, *s[2 * b : 2 * b + 2]), set()).add(r.id)
    return {p for ids in blocks.values() for p in itertools.combinations(sorted(ids), 2)}


def capped(queue, most):
    """By falling score, then ids, each pair that finds both its ends below ``most``."""
    count, kept = Counter(), []
    for pair in sorted(queue, key=lambda p: (-queue[p], p)):
        if all(count[end] < most for end in pair):
            count.update(pair)
            kept.append(pair)
    return kept


def planned(rows, minhash=True):
    """The plan's merges and queue, from all candidate pairs."""
    merges, queue, short = {}, {}, {}
    for a, b in candidates(rows, minhash):
        x, y = rows[a], rows[b]
        score = N.match_score(x.kind, [x.name, *x.aliases], y.kind, [y.name, *y.aliases])
        weight = lambda r: (len(r.aliases), len(r.name))
        winner, loser = (a, b) if weight(x) >= weight(y) else (b, a)
        if score >= N.AUTO_MERGE:
            merges[a, b] = (score, loser, winner)
            bare = next((i for i in (a, b) if len(rows[i].name.split()) == 1), None)
            if bare:
                short.setdefault(bare, {})[a, b] = winner
        elif score >= N.DISAMBIGUATE or x.kind == y.kind == "person" and set(x.forms) & set(y.forms):
            queue[a, b] = (score, loser, winner)
    for held in short.values():
        if len(set(held.values())) > 1:
            for p in held:
                if p in merges:
                    queue[p] = merges.pop(p)
    kept = capped({p: v[0] for p, v in queue.items()}, dedup.QUEUE_CAP)
    return {("merge", *p, *v[1:], round(v[0], 6)) for p, v in merges.items()} | {("queue", *p, *queue[p][1:], round(queue[p][0], 6)) for p in kept}


def test_token_blocks_hold_every_pair(spark, memory):
    ids = {}
    for r in catalogue.token_blocks(memory).collect():
        ids.setdefault(r.key, set()).add(r.id)
        assert r.size >= 2
    assert {p for x in ids.values() for p in itertools.combinations(sorted(x), 2)} == candidates(named(memory), False)
    assert {i[0] for x in ids.values() for i in x} == {"c", "s", "p"}


def test_dedup_plan_of_all_entities(spark, memory):
    got = {("merge" == r.action, r.loser, r.winner, r.score) for r in catalogue.dedup_plan(memory).collect()}
    assert got == {("merge" == x[0], *x[3:]) for x in planned(named(memory))} and any(not x[0] for x in got)


@pytest.mark.parametrize(("seed", "minhash"), [(1, True), (2, True), (3, False)])
def test_plan_matches_all_pairs(spark, seed, minhash):
    r = random.Random(seed)
    given, family = ["Ada", "Adam", "Jon", "John", "Karen"], ["Smith", "Smyth", "Hill", "Hills 2", "Lovelace Jr"]
    name = lambda: " ".join([r.choice(given), *r.choices(family, k=r.choice([0, 1, 1, 2]))])
    rows = [(f"x{i:02}", "person", name(), r.choice([[], ["VIP"], ["vip", name()]]), None) for i in range(24)]
    rows += [(f"v{i:02}", "person", f"Guest#{i:04}", ["north"], None) for i in range(17)]
    rows += [(f"w{i:02}", "person", "J P", r.choice([[], ["Al"]]), None) for i in range(9)]
    rows += [(f"k{i:02}", r.choice(["concept", "org"]), r.choice(["graph db", "Graph DB", "graph-db", "ab", "c d"]), r.choice([[], ["tool"], ["Tool."], ["ab"]]), None) for i in range(12)]
    e = spark.createDataFrame(rows, ENTITY)
    got = {(x.action, x.a, x.b, x.loser, x.winner, x.score) for x in dedup.plan(e, minhash=minhash).collect()}
    assert got == planned({x.id: x for x in dedup.named(e).collect()}, minhash)


def bits(x, y):
    """Evidence for a match, by the table of weights, from two rows' names."""
    light = lambda r: {" ".join(n.lower().split()) for n in [r.name, *r.aliases]}
    w = N.WEIGHTS["name"]
    if x.kind != y.kind:
        return N.WEIGHTS["kind"]["cross"]
    if x.kind != "person":
        return w["exact_light"] if light(x) & light(y) else w["punct_folded"] if set(x.forms) & set(y.forms) else w["disjoint"]
    met = [(N.Form.of(f), N.Form.of(g)) for f in x.forms for g in y.forms]
    if any(f.shortens(g) or g.shortens(f) for f, g in met):
        return w["containment"]
    best = w["disjoint"] if not any(len(f.core) > 1 < len(g.core) for f, g in met) else -math.inf
    for f, g in met:
        if len(f.core) > 1 < len(g.core):
            s = N.jaro_winkler(" ".join(f.core), " ".join(g.core))
            level = "identical_full" if f.core == g.core else "added_component" if len(f.core) != len(g.core) else "jw_hi" if s >= N.JW_MERGE else "jw_mid" if s >= N.JW_REVIEW else "jw_low"
            best = max(best, w[level] - 20 * (f.numbers != g.numbers) - 20 * (f.suffix != g.suffix))
    return best


@pytest.mark.parametrize("seed", [4, 5])
def test_fs_scores_match_the_table(spark, seed):
    r = random.Random(seed)
    given, family = ["Ada", "Adam", "Jon", "John", "Karen"], ["Smith", "Smyth", "Hill", "Hills 2", "Lovelace Jr", "Jr"]
    name = lambda: " ".join([r.choice(given), *r.choices(family, k=r.choice([0, 1, 1, 2]))])
    rows = [(f"x{i:02}", "person", name(), r.choice([[], ["VIP"], ["++"], [name()]]), None) for i in range(30)] + [("x98", "person", "++", [], None)]
    rows += [(f"k{i:02}", r.choice(["concept", "org"]), r.choice(["graph db", "Graph  DB", "graph-db", "ab", "C++", "++"]), r.choice([[], ["tool"], ["Tool."], ["++"]]), None) for i in range(20)]
    named = dedup.named(spark.createDataFrame(rows, ENTITY))
    by = {x.id: x for x in named.collect()}
    pairs = list(itertools.combinations(sorted(by), 2))
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = {(x.a, x.b): x.score for x in dedup.scored_pairs(frame, named, "fs").collect()}
    assert got == pytest.approx({(a, b): 1 / (1 + 2.0 ** -bits(by[a], by[b])) for a, b in pairs})
    plain = {(x.a, x.b): x.score for x in dedup.scored_pairs(frame, named).collect()}
    assert plain == pytest.approx({(a, b): N.match_score(by[a].kind, [by[a].name, *by[a].aliases], by[b].kind, [by[b].name, *by[b].aliases]) for a, b in pairs})


def test_fs_query_holds_every_pair_for_review(spark, memory):
    rows = named(memory)
    got = {(r.a, r.b): r.score for r in catalogue.fs_match_probability(memory).collect()}
    probable = lambda a, b: 1 / (1 + 2.0 ** -bits(rows[a], rows[b]))
    assert got == pytest.approx({p: probable(*p) for p in got}, abs=1e-6)
    assert {p for p in candidates(rows, False) if probable(*p) >= N.FS_QUEUE} == {p for p, s in got.items() if s >= N.FS_QUEUE}


def test_vector_batch_in_blocks(spark, memory, monkeypatch):
    monkeypatch.setattr(blocked, "QUERIES", 3)
    monkeypatch.setattr(blocked, "ROWS", 40)
    got = {}
    for r in catalogue.vector_batch_topk(memory).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    asked = {r.vec_id: r.embedding for r in spark.table("embeddings").where("vec_id % 50 = 0").collect()}
    rows = {r.id: r.embedding for r in memory.experiences.where("superseded_by IS NULL AND deleted_at IS NULL AND embedding IS NOT NULL").collect()}

    def cosine(x, y):
        return sum(a * b for a, b in zip(x, y)) / (math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)))

    for q, x in asked.items():
        best = sorted(((-cosine(x, y), i) for i, y in rows.items()))[:5]
        want = [(k, i, pytest.approx(-s, abs=2e-6)) for k, (s, i) in enumerate(best, 1) if s < 0]
        assert sorted(got.get(q, [])) == want
    assert len(asked) == 10


def test_resolve_batch_asks_for_every_kind(spark, memory, monkeypatch):
    monkeypatch.setattr(blocked, "QUERIES", 2)
    monkeypatch.setattr(blocked, "ROWS", 50)
    got = {}
    for r in catalogue.resolve_batch_topk(memory).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.entity_id, r.trgm_score))
    gram = lambda x: {f"  {w} "[i : i + 3] for w in re.split("[^a-z0-9]+", x.lower()) if w for i in range(len(w) + 1)}
    rows = [(r.id, r.kind, [gram(n) for n in (r.canonical_name, r.alias1) if n]) for r in memory.entities.where("merged_into IS NULL").collect()]
    asked = [(r.id, r.kind, gram(r.canonical_name)) for r in memory.entities.collect() if int(r.id[1:]) % 50 == 0]
    assert {q[0] for q, _, _ in asked} == {"c", "s", "p"}
    for q, kind, g in asked:
        scores = [(max(len(g & x) / len(g | x) for x in names), i) for i, k, names in rows if k == kind]
        best = sorted((-round(s, 5), i) for s, i in scores if s >= 0.3)[:5]
        assert [(k, i, pytest.approx(-s, abs=2e-5)) for k, (s, i) in enumerate(best, 1)] == sorted(got.get(q, []))


def test_provenance_of_every_experience(spark, memory):
    ids = {r.id for r in memory.experiences.select("id").collect()}
    claims = {r.id: r for r in memory.claims.where("polarity <> 'retracted' AND (confidence IS NULL OR confidence >= 0.6)").collect()}
    want = {}
    for r in memory.claim_sources.collect():
        if r.experience_id in ids and r.claim_id in claims:
            want.setdefault(r.experience_id, []).append(claims[r.claim_id])
    key = lambda c: (c.confidence is None, -(c.confidence or 0), c.created_at, c.id)
    got = {r.experience_id: r.claims for r in catalogue.provenance_block(memory).collect()}
    assert got == {e: ",".join(str(c.id) for c in sorted(x, key=key)) for e, x in want.items()} and max(got) >= 100


def test_minhash_bands_hold_every_pair(spark, memory):
    bands, want = {}, {}
    for r in catalogue.minhash_blocking_pairs(memory).collect():
        bands.setdefault(r.key, set()).add(r.id)
    for r in named(memory).values():
        s = signed(r.forms)
        for b in range(32):
            want.setdefault((r.kind, b, *s[2 * b : 2 * b + 2]), set()).add(r.id)
    assert sorted(map(sorted, bands.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert {i[0] for x in bands.values() for i in x} == {"c", "s", "p"}
