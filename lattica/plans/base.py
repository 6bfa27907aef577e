"""What the registered queries share: the present, stand-in frames and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.views import AS_OF, Memory

#: What the search queries look for: two words, and the vector of one item.
WORDS, VECTOR = "the of", 3
SEED = "c1"
#: While the first experiences came in.
EARLY = "2024-01-03 12:00:00"


def now(at: str = AS_OF) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{at}'")


def r6(*names: str) -> dict:
    return {n: F.round(F.col(n).cast("double"), 6) for n in names}


def entities(m: Memory) -> DataFrame:
    """With aliases as an array."""
    return m.entities.withColumn("aliases", F.filter(F.array("alias1"), lambda a: a.isNotNull())).withColumn("embedding", F.lit(None).cast("array<float>"))


def vector(m: Memory) -> list[float]:
    return m.spark.table("embeddings").where(F.col("vec_id") == VECTOR).select("embedding").first()[0]


def merge_candidates(m: Memory) -> DataFrame:
    """A review queue: the first part of each name with each other part of that name; every seventh pair was ruled apart."""
    p = m.spark.table("part").select(F.col("p_partkey").alias("j"), "p_name")
    near = p.join(p.groupBy("p_name").agg(F.min("j").alias("k")), "p_name").where("k < j")
    a, b = F.concat(F.lit("p"), F.col("k").cast("string")), F.concat(F.lit("p"), F.col("j").cast("string"))
    return near.select(
        (F.col("k") * 100000000 + F.col("j")).alias("id"), F.least(a, b).alias("entity_a"), F.greatest(a, b).alias("entity_b"), F.lit(0.9).alias("similarity"),
        F.when((F.col("k") + F.col("j")) % 7 == 0, "kept_separate").otherwise("pending").alias("status"), F.lit(None).cast("timestamp").alias("created_at"),
    )
