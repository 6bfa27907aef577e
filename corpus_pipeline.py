"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

The stages, in order: the quality classifier drops what it rejects; the quality rules drop what they reject; of each
group of near duplicates one document stays; documents contaminated by the benchmark go; what is left is packed.

A stage's input is its predecessor's written result, so when a stage starts it deletes the intermediate tables of the call
that made its input: of the calls of the stage before on this folder, the earliest whose tables are still there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import delete, durable, noted_files, table
from lattica.llm.decontamination import decontaminate
from lattica.llm.jaccard_join import first_of_groups
from lattica.llm.packing import pack
from lattica.llm.quality_rules import apply_rules
from lattica.llm.site_quality import classify


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: (stage's place, folder) -> the intermediate tables of each call.
_files: dict[tuple[int, str], list[list[str]]] = {}


def stage(place: int) -> Callable[[Stage], Stage]:
    """Notes the stage's intermediate tables and frees its predecessor's."""

    def of(work: Stage) -> Stage:
        @wraps(work)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = _files.get((place - 1, sf_dir))
            for path in before.pop(0) if before else []:
                delete(spark, path)
            with noted_files() as files:
                out = work(spark, docs, sf_dir)
            _files.setdefault((place, sf_dir), []).append(files)
            return out

        return run

    return of


@stage(0)
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang")).where("kept").select(*docs.columns)


@stage(1)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_rules(docs).where("kept").select(*docs.columns)


@stage(2)
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_groups(docs)


@stage(3)
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


@stage(4)
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The trained classifier and the fitted rules have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name.replace(" ", "-"))
    return docs
