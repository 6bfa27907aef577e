"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014).

Edges are kept as (u, v) with v the smaller node. Each step is a grouped minimum, with partial minima before the shuffle,
and a join that leaves the rows of hot nodes where they are. Every round is written to the shared folder, so plans stay
short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import durable
from lattica.llm.spread import spread_join

#: The steps converge in about the square of the logarithm of the nodes; more rounds than this mean a fault.
MAX_ROUNDS = 200


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the smallest node of its component.

    Edges of a node with itself and null ends are left out; without edges there are no rows.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(edges, "edges")
    before = state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # Large star: each node's larger neighbours go to the smallest of it and its neighbours.
        low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = spread_join(edges, low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = durable(large, "large-star")
        # Small star: each node's smaller neighbours, and it, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
