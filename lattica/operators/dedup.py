"""Batch duplicate detection: block, score, plan, guard."""

from __future__ import annotations

import random
from collections.abc import Iterable
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import names as N
from lattica.functions.text import folded
from lattica.sources.durable import durable

#: Of blocking and of the queue.
MIN_TOKEN, PERMUTATIONS, BANDS, SHINGLE, MODULUS, SEED, QUEUE_CAP = 3, 64, 32, 3, (1 << 61) - 1, 0xB0A17, 5
#: Into so many parts a block is dealt when all of its pairs are made.
SLICES = 16


def named(entities: DataFrame) -> DataFrame:
    """id, kind, name, aliases and the distinct folded forms of unmerged entities."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    forms = F.array_distinct(F.filter(F.transform(F.concat(F.array("canonical_name"), aliases), lambda x: folded(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    return entities.where(F.col("merged_into").isNull()).select("id", "kind", F.col("canonical_name").alias("name"), aliases.alias("aliases"), forms.alias("forms"))


def token_keys(rows: DataFrame) -> DataFrame:
    tokens = F.array_distinct(F.flatten(F.transform("forms", lambda f: F.filter(F.split(f, " "), lambda t: F.length(t) >= MIN_TOKEN))))
    return rows.select("id", F.explode(tokens).alias("t"), "kind").select("id", F.concat_ws("|", F.lit("t"), "kind", "t").alias("key"))


def coefficients() -> list[tuple[int, int]]:
    r = random.Random(SEED)
    return [(r.randrange(1, MODULUS), r.randrange(MODULUS)) for _ in range(PERMUTATIONS)]


def signature(form: str) -> list[int]:
    text = f" {form} "
    grams = {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}
    hashed = [int.from_bytes(blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams]
    return [min((a * h + b) % MODULUS for h in hashed) for a, b in coefficients()]


@F.pandas_udf(T.ArrayType(T.LongType()))
def signature_udf(forms: pd.Series) -> pd.Series:
    return forms.map(signature)


def minhash_keys(rows: DataFrame) -> DataFrame:
    """Band keys of one signature over all forms of a row.

    The signature of a union of sets is the least of their signatures, place by place, so each distinct form's is made once.
    """
    members = rows.select("id", "kind", F.explode("forms").alias("form"))
    signed = members.select("form").distinct().select("form", signature_udf("form").alias("s"))
    least = members.join(signed, "form").groupBy("id", "kind").agg(*(F.min(F.col("s")[i]).cast("string").alias(f"s{i}") for i in range(PERMUTATIONS)))
    width = PERMUTATIONS // BANDS
    bands = F.array(*(F.concat_ws("|", F.lit("m"), "kind", F.lit(str(b)), F.concat_ws("-", *(f"s{i}" for i in range(b * width, (b + 1) * width)))) for b in range(BANDS)))
    return least.select("id", F.explode(bands).alias("key"))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """(a, b) with a < b for rows that share a key: an equi-join on the blocking key."""
    left, right = keys.select(F.col("id").alias("a"), "key"), keys.select(F.col("id").alias("b"), "key")
    return left.join(right, "key").where(F.col("a") < F.col("b")).select("a", "b").distinct()


def shared_keys(keys: DataFrame) -> DataFrame:
    """(id, key) of the keys that more than one row has."""
    return keys.join(keys.groupBy("key").agg(F.countDistinct("id").alias("n")).where("n > 1").select("key"), "key", "left_semi").select("id", "key").distinct()


def blocks(keys: DataFrame) -> DataFrame:
    """key, id and the block's size: the candidate pairs are the pairs of ids within a block, so a hot key stays linear."""
    size = keys.distinct().groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return keys.distinct().join(size, "key").select("key", "id", "size")


def spread_pairs(keys: DataFrame) -> DataFrame:
    """``candidate_pairs`` without a distinct over pairs: each is made at its first shared key, and hot keys are dealt out."""
    lists = shared_keys(keys).groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    each = lists.select("id", "keys", F.explode("keys").alias("key"))
    left = each.select(F.col("id").alias("a"), F.col("keys").alias("ka"), "key", F.pmod(F.xxhash64("id"), F.lit(SLICES)).alias("s"))
    right = each.select(F.col("id").alias("b"), F.col("keys").alias("kb"), "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))).alias("s"))
    met = left.join(right, ["key", "s"]).where(F.col("a") < F.col("b"))
    return met.where(F.array_min(F.array_intersect("ka", "kb")) == F.col("key")).select("a", "b")


def reasons(rows: DataFrame) -> DataFrame:
    """(id, why, key): what a person's forms can score by: full, comparable forms; bare, a given name alone; word, of a longer name."""
    forms = rows.where("kind = 'person'").select("id", F.explode("forms").alias("form")).select("id", N.parts(F.col("form")).alias("x"))
    full = forms.where("x.n >= 2").select("id", F.lit("full").alias("why"), F.concat_ws("|", "x.n", "x.suffix", "x.numbers").alias("key"))
    words = forms.select("id", F.when(F.size("x.words") == 1, "bare").otherwise("word").alias("why"), F.explode("x.words").alias("key"))
    return full.union(words).distinct()


def ordered(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    met = a.select(F.col("id").alias("a"), *on).join(b.select(F.col("id").alias("b"), *on), on).where(F.col("a") != F.col("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def telling_pairs(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidate pairs of persons with comparable forms, or with a given name within a longer name."""
    found = reasons(rows)
    at = lambda why: found.where(F.col("why") == why).select("id", F.col("key").alias("r"))
    full, bare, word = at("full"), at("bare"), at("word")
    full = full.join(full.groupBy("r").count().where("count > 1"), "r", "left_semi").join(keys, "id")
    bare, word = bare.join(word.select("r").distinct(), "r", "left_semi").join(keys, "id"), word.join(bare.select("r").distinct(), "r", "left_semi").join(keys, "id")
    return ordered(full, full, ["r", "key"]).union(ordered(bare, word, ["r", "key"]))


def shared_forms(rows: DataFrame) -> DataFrame:
    """(kind, form, id, n) of the forms that more than one row of a kind has."""
    forms = rows.select("id", "kind", F.explode("forms").alias("form"))
    return forms.join(forms.groupBy("kind", "form").agg(F.count("*").alias("n")).where("n > 1"), ["kind", "form"])


def judged_pairs(keys: DataFrame, rows: DataFrame, flat: bool) -> DataFrame:
    """The candidate pairs that ``plan`` can act on, made from what a score needs instead of from all pairs of a block.

    A score needs a shared form or, between persons, comparable forms or a given name within a longer name. Persons that
    share a form and nothing else all score 0 if ``flat``; a group of them that meets no other pair is reduced to runs of
    ``QUEUE_CAP + 1`` ids, which is what the greedy cap keeps of it.
    """
    forms, on = shared_forms(rows), ["kind", "form"]
    # A word long enough for a token key makes all that share the form candidates; else another key has to.
    telling = F.exists(F.split("form", " "), lambda t: F.length(t) >= MIN_TOKEN)
    whole, faint = forms.where(telling), forms.where(~telling).join(keys, "id")
    other = whole.where("kind != 'person'") if flat else whole
    pairs = telling_pairs(keys, rows).union(ordered(other, other, on)).union(ordered(faint, faint, [*on, "key"])).distinct()
    if flat:
        pairs, people = durable(pairs, "pairs"), whole.where("kind = 'person'")
        busy = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(people.groupBy("id").count().where("count > 1").select("id")).distinct()
        mixed = people.join(busy, "id", "left_semi").select("form").distinct()
        mixed, alone = people.join(mixed, "form", "left_semi"), people.join(mixed, "form", "left_anti")
        run = F.floor((F.row_number().over(W.partitionBy("form").orderBy("id")) - 1) / (QUEUE_CAP + 1))
        runs = alone.withColumn("run", run)
        pairs = pairs.union(ordered(mixed, mixed, on)).union(ordered(runs, runs, [*on, "run"])).distinct()
    return durable(pairs, "pairs")


def scored_pairs(pairs: DataFrame, rows: DataFrame, scorer: str = "default") -> DataFrame:
    """``pairs`` (a, b, each once) with both ends' fields and their score: default, or fs, a probability from summed evidence.

    Names of persons are compared form by form, as rows; the best comparison of a pair counts.
    """
    light = F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), "aliases"), lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))), lambda x: x != ""))
    known = rows.withColumn("light", light)
    side = lambda e: known.select(F.col("id").alias(e), *(F.col(c).alias(f"{c[0] if c != 'aliases' else 'x'}{e}") for c in ("kind", "name", "aliases", "forms", "light")))
    joined = durable(pairs.join(side("a"), "a").join(side("b"), "b"), "joined-pairs")
    person = (F.col("ka") == "person") & (F.col("kb") == "person")
    met = joined.where(person).select("a", "b", F.explode("fa").alias("x"), "fb").select("a", "b", "x", F.explode("fb").alias("y"))
    met = met.select("a", "b", N.parts(F.col("x")).alias("x"), N.parts(F.col("y")).alias("y")).withColumn("jw", N.jaro_winkler_udf("x.core", "y.core"))
    x, y, jw = F.col("x"), F.col("y"), F.col("jw")
    agree = {"suffix": x["suffix"] == y["suffix"], "numeric": x["numbers"] == y["numbers"]}
    if scorer == "fs":
        nearness = F.when(x["core"] == y["core"], "identical_full").when(x["n"] != y["n"], "added_component")
        for level, bar in (("jw_hi", N.JW_MERGE), ("jw_mid", N.JW_REVIEW), ("jw_low", 0.0)):
            nearness = nearness.when(jw >= bar, level)
        worth = N.evidence("name", nearness)
        for feature, same in agree.items():
            worth = worth + N.evidence(feature, F.when(same, "agree").otherwise("disagree"))
        counts = (x["n"] >= 2) & (y["n"] >= 2)
    else:
        worth, counts = jw, (x["n"] >= 2) & (x["n"] == y["n"]) & (x["core"] != y["core"]) & agree["suffix"] & agree["numeric"]
    best = met.groupBy("a", "b").agg(F.max(N.abridges(x, y) | N.abridges(y, x)).alias("short"), F.max(F.when(counts, worth)).alias("worth"))
    out = joined.join(best, ["a", "b"], "left")
    same_light, same_form = F.arrays_overlap("la", "lb"), F.arrays_overlap("fa", "fb")
    if scorer == "fs":
        name = F.when(person, F.when(F.col("short"), N.evidence("name", "containment")).otherwise(F.coalesce("worth", N.evidence("name", "disjoint"))))
        name = name.otherwise(N.evidence("name", F.when(same_light, "exact_light").when(same_form, "punct_folded").otherwise("disjoint")))
        bits = F.when(F.col("ka") != F.col("kb"), N.evidence("kind", "cross")).otherwise(N.evidence("kind", "agree") + name)
        score = 1 / (1 + F.pow(F.lit(2.0), -bits))
    else:
        either = F.when(person, F.when(F.col("short"), N.CONTAINMENT).otherwise(F.coalesce("worth", F.lit(0.0))))
        score = F.when(F.col("ka") != F.col("kb"), 0.0).otherwise(either.otherwise(F.when(same_light & (F.size("fa") > 0) & (F.size("fb") > 0), 1.0).when(same_form, N.CONTAINMENT).otherwise(0.0)))
    return out.withColumn("score", score).drop("short", "worth", "la", "lb")


def contested(merges: DataFrame) -> DataFrame:
    """ids with two merge partners that are not merged with each other. ``merges``: a, b.

    An id is contested if it has fewer triangles than pairs of partners. Triangles are found from their end of least degree,
    so that hubs are never joined with themselves: the work is at most the edges' number to the power of 1.5.
    """
    edges = durable(merges.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).where("p <> q").distinct(), "merge-pairs")
    degree = edges.select(F.col("p").alias("id")).union(edges.select("q")).groupBy("id").agg(F.count("*").alias("n"))
    rank = lambda e: degree.select(F.col("id").alias(e), F.struct("n", "id").alias(f"{e}r"))
    held = edges.join(rank("p"), "p").join(rank("q"), "q")
    up = held.select(F.least("pr", "qr").getField("id").alias("low"), F.greatest("pr", "qr").alias("high"))
    pairs = up.select("low", F.col("high").alias("x")).join(up.select("low", F.col("high").alias("y")), "low").where(F.col("x") < F.col("y"))
    pairs = pairs.select("low", F.least("x.id", "y.id").alias("p"), F.greatest("x.id", "y.id").alias("q"))
    corners = pairs.join(edges, ["p", "q"], "left_semi").select(F.explode(F.array("low", "p", "q")).alias("id"))
    triangles = corners.groupBy("id").agg(F.count("*").alias("closed"))
    open_pairs = F.col("n") * (F.col("n") - 1) / 2 > F.coalesce("closed", F.lit(0))
    return degree.join(triangles, "id", "left").where(open_pairs).select("id")


def trimmed(queue: DataFrame, most: int = QUEUE_CAP) -> DataFrame:
    """Greedily by score, at most ``most`` pairs for each end, over a frame (a, b, score): the choice as a fixed point of rounds.

    In a round a pair is decided once every better pair at either of its ends is: it is taken if both ends have room. So
    the queue is never gathered; rounds end when nothing is open.
    """
    open_pairs = durable(queue.select("a", "b", "score"), "queue")
    taken = open_pairs.limit(0)
    while open_pairs.take(1):
        order = [F.desc("score"), F.asc("a"), F.asc("b")]
        ends = open_pairs.select(F.col("a").alias("end"), "a", "b", "score").union(open_pairs.select("b", "a", "b", "score"))
        ranked = ends.withColumn("k", F.row_number().over(W.partitionBy("end").orderBy(*order)))
        used = taken.select(F.col("a").alias("end")).union(taken.select("b")).groupBy("end").agg(F.count("*").alias("n"))
        state = ranked.join(used, "end", "left").withColumn("room", F.lit(most) - F.coalesce("n", F.lit(0)))
        # Within the room of both ends whatever becomes of the better ones; or beyond hope because an end is full.
        per_pair = state.groupBy("a", "b", "score").agg(F.min((F.col("k") <= F.col("room")).cast("int")).alias("sure"), F.max((F.col("room") <= 0).cast("int")).alias("full"))
        decided = durable(per_pair.where("sure = 1 OR full = 1"), "decided")
        taken = durable(taken.union(decided.where("sure = 1 AND full = 0").select("a", "b", "score")), "taken")
        open_pairs = durable(open_pairs.join(decided.select("a", "b"), ["a", "b"], "left_anti"), "queue")
    return taken


def plan(entities: DataFrame, scorer: str = "default", minhash: bool = True, held: DataFrame | None = None) -> DataFrame:
    """action (merge or queue), loser, winner, a, b, score. ``held``: pairs (a, b) ruled apart, which are not merged."""
    rows = named(entities)
    keys = token_keys(rows).union(minhash_keys(rows)) if minhash else token_keys(rows)
    auto, low = (N.FS_AUTO, N.FS_QUEUE) if scorer == "fs" else (N.AUTO_MERGE, N.DISAMBIGUATE)
    scored = scored_pairs(judged_pairs(keys.distinct(), rows, scorer == "default"), rows, scorer)
    same_person = (F.col("ka") == "person") & (F.col("kb") == "person") & F.arrays_overlap("fa", "fb")
    weight = lambda x, n: F.struct(F.size(x), F.length(n))
    left_wins = (weight("xa", "na") > weight("xb", "nb")) | ((weight("xa", "na") == weight("xb", "nb")) & (F.col("a") < F.col("b")))
    judged = scored.withColumns({
        "action": F.when(F.col("score") >= auto, "merge").when((F.col("score") >= low) | same_person, "queue"),
        "winner": F.when(left_wins, F.col("a")).otherwise(F.col("b")),
        "loser": F.when(left_wins, F.col("b")).otherwise(F.col("a")),
        "short": F.when(F.size(F.split("na", r"\s+")) == 1, F.col("a")).when(F.size(F.split("nb", r"\s+")) == 1, F.col("b")),
    }).where(F.col("action").isNotNull()).select("action", "loser", "winner", "a", "b", "score", "short")
    if scorer == "fs":
        apart = contested(judged.where("action = 'merge'"))
        for end in ("a", "b"):
            judged = judged.join(apart.select(F.col("id").alias(end), F.lit(True).alias(f"c{end}")), end, "left")
        judged = judged.withColumn("action", F.when(F.coalesce("ca", "cb").isNotNull(), "queue").otherwise(F.col("action"))).drop("ca", "cb")
    # A bare given name that would go into more than one winner goes into none.
    greedy = judged.where("action = 'merge' AND short IS NOT NULL").groupBy("short").agg(F.countDistinct("winner").alias("n")).where("n > 1").select("short", F.lit(True).alias("torn"))
    judged = judged.join(greedy, "short", "left").withColumn("action", F.when(F.col("torn"), "queue").otherwise(F.col("action"))).drop("torn", "short")
    queue = trimmed(judged.where("action = 'queue'")).select("a", "b")
    kept = judged.where("action = 'merge'").unionByName(judged.where("action = 'queue'").join(queue, ["a", "b"], "left_semi"))
    if held is not None:
        ruled = held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        kept = kept.where("action = 'queue'").unionByName(kept.where("action = 'merge'").join(ruled, ["a", "b"], "left_anti"))
    return kept.select("action", "loser", "winner", "a", "b", F.round("score", 6).alias("score"))


def held_pairs(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b) of survivors that a reviewer kept apart or skipped."""
    dim = entities.select(F.col("id").alias("x"), F.coalesce("merged_into", "id").alias("s"))
    ruled = candidates.where(F.col("status").isin("kept_separate", "skipped"))
    both = ruled.join(dim.toDF("entity_a", "sa"), "entity_a").join(dim.toDF("entity_b", "sb"), "entity_b").where(F.col("sa") != F.col("sb"))
    return both.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()
