"""The quality operators against brute force: every count, the fit of the rules, and the sites' posteriors."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality_rules as Q
from lattica.llm import site_quality as S
from lattica.llm.features import COUNTS, count

DOC = "doc_id long, text string, lang string, source string"
ODD = [None, "", " ", "\n\n", "one", "a b c d e a b c d e", "x y z w v u\nx y z w v u\n\nx y z w v u", "# * $ % & | < >", "é b c d 🙂", "w " * 50, "tab\there\x0bvt\x0cff\rcr", "a b c d e f " * 9 + "tail"]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def texts(seed):
    r = random.Random(seed)
    pool = ["aa", "bb", "c", "dd.", "EE", "f|f", "g#"]
    made = [" ".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(40)]
    return [*ODD, *made, *("\n".join(r.choice(["k l m n o", "p q", "", " "]) for _ in range(12)) for _ in range(12))]


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}") for k, t in enumerate(rows)], DOC)


def test_counts_match_brute_force(spark):
    rows = texts(1)
    for x in Q.apply_rules(docs(spark, rows)).collect():
        want = brute_counts(rows[x.doc_id])
        assert tuple(x[c] for c in COUNTS) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_a_very_long_text(spark):
    long = " ".join(f"w{k % 70_001}" for k in range(180_000))
    got = Q.apply_rules(docs(spark, [long, "a " * 500_000])).orderBy("doc_id").collect()
    assert [tuple(x[c] for c in COUNTS) for x in got] == [brute_counts(long), brute_counts("a " * 500_000)]


def numpy_fit(v, n, rounds):
    """The same model by arrays."""
    total, k = n.sum(), v.shape[1]
    belief = np.array(Q.BELIEF)
    t, pi = np.tile(belief, (k, 1, 1)), 0.5
    cast = np.stack([v == x for x in (-1, 0, 1)], -1).astype(float)
    for _ in range(rounds):
        odds = math.log(pi / (1 - pi)) + (cast * (np.log(t[:, 1]) - np.log(t[:, 0]))).sum((1, 2))
        good = n / (1 + np.exp(-odds))
        mass = np.stack([n - good, good])
        cells = np.einsum("cp,pkv->kcv", mass, cast)
        t = (Q.BELIEF_WEIGHT * total * belief + cells) / (Q.BELIEF_WEIGHT * total + mass.sum(1))[None, :, None]
        pi = (good.sum() + 1) / (total + 2)
    return pi, t


def voted(spark, votes):
    """Documents whose words spell out the votes, and rules that read them: word i is good, bad or none."""
    rows = [" ".join([*({1: "g", 0: "n", -1: "b"}[x] + str(j) for j, x in enumerate(v)), *(f"pad{i}" for i in range(12))]) for v in votes]
    has = lambda w: F.col("text").contains(w)
    rules = {f"r{j}": F.when(has(f"b{j} "), -1).when(has(f"g{j} "), 1).otherwise(0) for j in range(len(votes[0]))}
    return docs(spark, rows), rules


def drawn(seed, n, accuracy, share=0.8):
    """Votes of rules of different accuracy, and the classes."""
    r = random.Random(seed)
    classes = [r.random() < share for _ in range(n)]
    return classes, [[0 if r.random() < 0.15 else (1 if (r.random() < a) == c else -1) for a in accuracy] for c in classes]


@pytest.mark.parametrize("rounds", [1, 7, 40])
def test_fit_matches_numpy(spark, rounds):
    _, votes = drawn(2, 400, [0.95, 0.9, 0.8, 0.6])
    df, rules = voted(spark, votes)
    patterns = df.select(F.array(*rules.values()).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    pi, t = Q.fit(patterns, len(rules), rounds)
    own = Counter(map(tuple, votes))
    want_pi, want_t = numpy_fit(np.array(list(own)), np.array(list(own.values()), float), rounds)
    assert pi == pytest.approx(want_pi, abs=1e-9) and t == pytest.approx(want_t.ravel().tolist(), abs=1e-9)


def test_accuracies_are_learned_and_outvote_the_majority(spark):
    """A lone bad vote of an inaccurate rule keeps a document; bad votes of accurate rules beat a majority of weak good ones."""
    classes, votes = drawn(3, 3000, [0.97, 0.97, 0.55, 0.55, 0.55])
    votes += [[1, 1, -1, 0, 0], [1, 1, -1, 1, 1], [-1, -1, 1, 1, 1]]
    df, rules = voted(spark, votes)
    got = {x.doc_id: x for x in Q.apply_rules(df, rules=rules).collect()}
    assert got[3000].kept and got[3001].kept and not got[3002].kept
    assert np.mean([got[k].kept == c for k, c in enumerate(classes)]) > 0.95


def test_standard_rules_do_not_need_all_to_pass(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "er", "lo", "mi", "ta", "su"]) for _ in range(r.randint(2, 3)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(6, 14))).capitalize() + "."
    clean = [" ".join(sentence() for _ in range(6)) for _ in range(150)]
    lines = [[sentence() + " " + sentence() for _ in range(7)] for _ in range(12)]
    quoted = ["\n".join(["Part.", *x[:3], "Part.", *x[3:]]) for x in lines]
    junk = [" | ".join(word() for _ in range(40)) for _ in range(10)] + [" ".join(w.upper() + "!!" for w in clean[k].split()) for k in range(10)]
    got = {x.doc_id: x for x in Q.apply_rules(docs(spark, [*clean, *quoted, *junk])).collect()}
    assert all(got[k].kept for k in range(162)), "one repeated line rejects nothing"
    assert not any(got[k].kept for k in range(162, 182))


def test_clashing_columns_stay_or_are_replaced(spark):
    extra = ["n_path", "n_host", "s_host", "s_path", "parent", "n_lines", "_t", "_w", "_h", "n", "s", "v"]
    df = docs(spark, texts(5)).select("*", *(F.lit(f"own {c}").alias(c) for c in extra), F.lit("old").alias("kept"), F.lit("old").alias("n_words"), F.lit("old").alias("host"))
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    for out in (Q.apply_rules(df), S.classify(df, labels, F.col("source"), F.col("lang"))):
        assert len(set(out.columns)) == len(out.columns)
        row = out.where("doc_id = 20").first()
        assert all(row[c] == f"own {c}" for c in extra) and isinstance(row["kept"], bool)
    assert Q.apply_rules(df).where("doc_id = 20").first()["host"] == "old"


def brute_posteriors(rows):
    """(p_host, p_path, p_quality) from (host, path, p_document), by sums in Python."""
    n, s = defaultdict(int), defaultdict(float)
    for h, g, p in rows:
        for key in ((), (h,), (h, g)):
            n[key] += 1
            s[key] += p
    mean = min(max(s[()] / n[()], 1e-6), 1 - 1e-6)

    def strength(keys, parent):
        keys = [k for k in keys if n[k] > 1]
        size = sum(n[k] for k in keys)
        if len(keys) < 2 or not size:
            return S.STRENGTHS[1]
        between = sum(n[k] * (s[k] / n[k] - parent(k)) ** 2 for k in keys)
        excess = (between - sum(parent(k) * (1 - parent(k)) for k in keys)) / size
        spread = sum(n[k] * parent(k) * (1 - parent(k)) for k in keys) / size
        return min(max(spread / excess - 1, S.STRENGTHS[0]), S.STRENGTHS[1]) if excess > 0 else S.STRENGTHS[1]

    k_host = strength([k for k in n if len(k) == 1], lambda k: mean)
    parent = {k: (k_host * mean + s[k]) / (k_host + n[k]) for k in n if len(k) == 1}
    k_path = strength([k for k in n if len(k) == 2], lambda k: parent[k[:1]])
    for h, g, p in rows:
        of_host = (k_host * mean + s[h,] - p) / (k_host + n[h,] - 1)
        of_path = (k_path * of_host + s[h, g] - p) / (k_path + n[h, g] - 1)
        held = min(max(of_path, 1e-6), 1 - 1e-6)
        odds = math.log(p / (1 - p)) + math.log(held / (1 - held)) - math.log(mean / (1 - mean))
        yield of_host, of_path, 1 / (1 + math.exp(-odds))


def test_posteriors_match_brute_force(spark):
    r = random.Random(6)
    hosts = [r.choice(["a", "a", "a", "b", "c", None]) for _ in range(200)]
    rows = [(k, " ".join([r.choice(["ok", "fine.", "BAD!!"]) if h != "b" else "BAD!!" for _ in range(20)]), r.choice(["x", "y", None]), h) for k, h in enumerate(hosts)]
    df = spark.createDataFrame(rows, DOC)
    labels = df.select("doc_id", (~F.col("text").contains("BAD!! BAD!!")).cast("int").alias("quality")).where("doc_id % 2 = 0")
    got = S.classify(df, labels, F.col("source"), F.col("lang")).orderBy("doc_id").collect()
    assert [(x.host, x.path) for x in got] == [(h, g) for _, _, g, h in rows]
    want = brute_posteriors([(x.host, x.path, x.p_document) for x in got])
    for x, w in zip(got, want, strict=True):
        assert (x.p_host, x.p_path, x.p_quality) == pytest.approx(w, abs=1e-9) and x.kept == (x.p_quality >= 0.5)


def test_the_model_takes_a_bounded_number_of_rows(spark):
    df = docs(spark, texts(7)).union(docs(spark, texts(8))).union(spark.createDataFrame([(3, "again " * k, "en", "s") for k in range(50)], DOC))
    labels = spark.createDataFrame([(k % 9, k % 2) for k in range(40)], "doc_id long, quality int")
    seen = S.classify(df, labels, F.col("source"), F.col("lang"), max_labels=5)
    assert seen.count() == df.count()
    assert count("n_words") is not None
