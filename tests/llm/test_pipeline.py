import re
from collections import Counter

import pytest

import corpus_pipeline
from lattica.llm.decontamination import decontaminate
from lattica.llm.queries import op10_quality_rules

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def base_failed(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(5)}
    return len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's decision on its own input; the classifier and the rules against labels, the others exactly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == docs.columns
            kept = {r.doc_id for r in out.collect()}
        if k < 2:
            # Labelled documents go if they are bad; good ones only if they fail the base rule.
            assert not [d for d in before if d not in kept and labels.get(d) == 1 and not (k == 1 and base_failed(before[d]))]
            assert len([d for d in kept if labels.get(d) == 0]) <= 1
        elif k == 2:
            sets = {d: shingles(t) for d, t in before.items()}
            near = {d: {e for e in sets if e != d and sets[d] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])} for d in sets}
            seen, firsts = set(), set()
            for d in sorted(sets):
                if d not in seen:
                    firsts.add(d)
                    todo = [d]
                    while todo:
                        x = todo.pop()
                        if x not in seen:
                            seen.add(x)
                            todo += near[x]
            assert kept == firsts
        elif k == 3:
            bad = decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").select("doc_id").collect()
            assert kept == set(before) - {r.doc_id for r in bad}
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
        docs = out


def test_run_packs_what_is_kept(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_a_stage_leaves_other_results_alone(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lazy = op10_quality_rules(spark, SF)
    first, other = (corpus_pipeline.quality_classifier(spark, docs, SF) for _ in range(2))
    first.write.parquet(str(tmp_path / "first"))
    second = corpus_pipeline.quality_rules(spark, spark.read.parquet(str(tmp_path / "first")), SF)
    assert lazy.count() == docs.count() and other.count() == first_count(spark, tmp_path) and second.count() > 0


def first_count(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "first")).count()


ODD = [
    (None, None, None, None, None), (1, None, "en", "s0", 0), (2, "", None, None, None), (2, "", None, None, None), (3, "  \n ", "en", "s0", 4), (4, "one two", "en", "s0", 7), (4, "one two", "en", "s0", 7), (None, "one two", "en", "s0", 7),
    (5, "A quick sentence about something. " * 3, "en", "s1", 99), (6, "word " * 200_000, "en", "s1", 1_000_000), (7, " " * 1_000_000, "en", "s1", 1_000_000),
]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, empty and very long texts, repeated rows, no rows: kept rows are rows of the stage's input."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = {hash(tuple(r)) for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns and {hash(tuple(r)) for r in out.collect()} <= before
        else:
            assert len({r.doc_id for r in out.collect()}) == len({r[0] for r in rows})
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept if r.text == "one two") == ([4] if rows else [])
