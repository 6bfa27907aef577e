"""Exact links and groups within clusters of shingle sets, whatever a cluster's size.

A cluster that fits a task is compared there. In a larger one every set A is written as its difference D from the
cluster's smallest set P; with m = |P - A| the intersection of A and B is |P| - m(A) - m(B) + |D(A) & D(B)|, so texts are
read once and differences, which are short among near copies, are all that is compared. Sets are dealt into blocks by
h = m + s / (1 + s) * |A|: where h(A) + h(B) <= |P|, A and B are linked at similarity s whatever they have in common
beside P, so pairs of blocks for which this holds throughout are counted by their weights alone, and of blocks whose
sizes rule links out nothing is compared. The other pairs of blocks are rows of their own, one for each pair of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import durable, is_empty
from lattica.llm.shingles import fingerprint, shingles, unite
from lattica.llm.spread import by_group, spread_join

#: Nodes and shingles of a cluster, or of a block of one, in a task.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Steps of h by which a large cluster is dealt into blocks, for each |P|.
STEPS = 64
#: Pairs of owners of a shingle up to which they are listed; beyond, a column of a matrix product.
LISTED = 64
ROUNDING = 1e-6


def owners(sets: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``a`` with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    tokens = np.concatenate([*a, *b])
    if not len(tokens):
        return out
    split = sum(map(len, a))
    values, place = np.unique(tokens, return_inverse=True)
    sides = []
    for at, owner in ((place[:split], owners(a)), (place[split:], owners(b))):
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=len(values))
        sides.append((at[order], owner[order], n, np.cumsum(n) - n))
    (place_a, own_a, n_a, from_a), (place_b, own_b, n_b, from_b) = sides
    pairs = n_a * n_b
    listed = np.flatnonzero((pairs > 0) & (pairs <= LISTED))
    for part in np.array_split(listed, max(1, int(pairs[listed].sum()) >> 19)):
        n = pairs[part]
        which = np.repeat(part, n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = own_a[from_a[which] + k // n_b[which]], own_b[from_b[which] + k % n_b[which]]
        out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape)
    often = np.cumsum(pairs > LISTED)
    step = max(256, (1 << 22) // max(out.shape))
    for low in range(0, int(often[-1]), step):
        parts = []
        for at, owner, n in ((place_a, own_a, len(a)), (place_b, own_b, len(b))):
            column = often[at] - 1 - low
            use = (pairs[at] > LISTED) & (column >= 0) & (column < step)
            part = np.zeros((n, step), np.float32)
            part[owner[use], column[use]] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


LINK = [T.StructField("fp", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("tie", T.BinaryType())]
#: Of a set in a large cluster: what it differs in from the cluster's smallest one.
APART = [
    T.StructField("root", T.BinaryType()),
    T.StructField("weight", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("missing", T.LongType()),
    T.StructField("of", T.LongType()),
    T.StructField("diff", T.BinaryType()),
]
COMPARED = T.StructType([*LINK, *APART])
KINDS = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def batch_of(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch | None:
    kinds = {T.BinaryType(): pa.binary(), T.LongType(): pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[f.dataType]) for k, f in enumerate(schema.fields)], names=schema.names) if rows else None


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return both >= similarity * (a[:, None] + b[None, :] - both) - ROUNDING


def compare_cluster(width: int, similarity: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Links within a cluster that fits; the differences of a part of one that does not."""

    def work(group: pa.Table) -> pa.RecordBatch | None:
        rows: dict[bytes, tuple[np.ndarray, int]] = {}
        smallest = None
        for fp, text, weight, first in zip(*(group.column(c).to_pylist() for c in ("fp", "text", "weight", "first")), strict=True):
            if fp in rows and not first:
                continue
            own = shingles(text, width)
            if fingerprint(own) != fp:  # an id may have more than one text
                continue
            if first:
                smallest = own
            else:
                rows[fp] = own, weight
        fps, sets, weights = list(rows), [r[0] for r in rows.values()], np.array([r[1] for r in rows.values()])
        if not group.column("large")[0].as_py():
            if len(sets) < 2:
                return None
            size = np.array(list(map(len, sets)))
            near = similar(shared_counts(sets, sets), size, size, similarity)
            np.fill_diagonal(near, False)
            links, root = near @ weights, unite(near)
            return batch_of([(fps[i], int(links[i]), fps[root[i]], *[None] * 6) for i in np.flatnonzero(links)], COMPARED)
        root, out = group.column("root")[0].as_py(), []
        for fp, own, weight in zip(fps, sets, weights.tolist(), strict=True):
            diff = np.setxor1d(own, smallest, assume_unique=True)
            missing = (len(diff) - len(own) + len(smallest)) // 2
            out.append((fp, None, None, root, weight, len(own), missing, len(smallest), diff.astype("<u8").tobytes()))
        return batch_of(out, COMPARED)

    return work


BLOCKS = T.StructType([
    T.StructField("root", T.BinaryType()),
    T.StructField("block", T.LongType()),
    T.StructField("of", T.LongType()),
    *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("weight", "size", "missing", "n")),
    T.StructField("fps", T.BinaryType()),
    T.StructField("diffs", T.BinaryType()),
])


def pack_block(group: pa.Table) -> pa.RecordBatch:
    """One row for a block's sets."""
    diffs = group.column("diff").to_pylist()
    values = [[group.column("root")[0].as_py()], [group.column("block")[0].as_py()], [group.column("of")[0].as_py()]]
    values += [[group.column(c).to_pylist()] for c in ("weight", "size", "missing")]
    values += [[[len(d) // 8 for d in diffs]], [b"".join(group.column("fp").to_pylist())], [b"".join(diffs)]]
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.binary(), pa.int64(), pa.int64(), longs, longs, longs, longs, pa.binary(), pa.binary()), strict=True)], names=BLOCKS.names)


def sides(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a two-sided graph as the first left member; -1 where there is none."""
    left, right = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for i in range(len(left)):
        if left[i] < 0 and near[i].any():
            front = np.array([i])
            while len(front):
                left[front] = i
                reached = np.flatnonzero(near[front].any(0) & (right < 0))
                right[reached] = i
                front = np.flatnonzero(near[:, reached].any(1) & (left < 0))
    return left, right


def compare_blocks(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = T.StructType(LINK)

    def opened(block: dict) -> tuple:
        fps = [block["fps"][k : k + 16] for k in range(0, len(block["fps"]), 16)]
        sets = np.split(np.frombuffer(block["diffs"], "<u8"), np.cumsum(block["n"])[:-1])
        return fps, sets, *(np.array(block[c]) for c in ("weight", "size", "missing"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].as_py() for c in ("left", "right"))
                fps, sets, weight, size, missing = opened(a)
                fps_b, sets_b, weight_b, size_b, missing_b = opened(b)
                both = a["of"] - missing[:, None] - missing_b[None, :] + shared_counts(sets, sets_b)
                near = similar(both, size, size_b, similarity)
                if a["block"] == b["block"]:
                    np.fill_diagonal(near, False)
                    links, root = near @ weight, unite(near)
                    rows = [(fps[i], int(links[i]), fps[root[i]]) for i in np.flatnonzero(links)]
                else:
                    links, links_b = near @ weight_b, weight @ near
                    root, root_b = sides(near)
                    rows = [(fps[i], int(links[i]), fps[root[i]]) for i in np.flatnonzero(links)]
                    rows += [(fps_b[j], int(links_b[j]), fps[root_b[j]]) for j in np.flatnonzero(links_b)]
                made = batch_of(rows, schema)
                if made is not None:
                    yield made

    return run


def large_links(apart: DataFrame, similarity: float) -> DataFrame:
    """fp, links and tie of the sets of large clusters."""
    h = F.col("missing") + F.lit(similarity / (1 + similarity)) * F.col("size")
    apart = apart.withColumns({"h": h, "step": F.floor(h * STEPS / F.col("of")), "parted": F.xxhash64("root", F.floor(h * STEPS / F.col("of")))})
    apart = durable(apart, "differences")
    steps = apart.groupBy("parted").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("diff")) / (8 * BLOCK_SHINGLES))).cast("long").alias("parts"))
    dealt = spread_join(apart, steps, "parted").withColumn("block", F.xxhash64("step", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts"))))
    dealt = durable(dealt.withColumn("key", F.xxhash64("root", "block")), "dealt")
    blocks = dealt.groupBy("root", "block", "of").agg(
        F.max("h").alias("h"), F.sum("weight").alias("weight"), F.min("fp").alias("first"), F.min("size").alias("least"), F.max("size").alias("most")
    )
    blocks = durable(blocks, "blocks")
    other = blocks.select("root", *(F.col(c).alias(f"{c}_b") for c in ("block", "h", "weight", "first", "least", "most")))
    pairs = blocks.join(other, "root")
    sure = F.col("h") + F.col("h_b") <= F.col("of") - F.lit(ROUNDING)
    # Whichever block lies nearest to the smallest set is linked to every block that is sure of any.
    counted = pairs.where(sure).groupBy("root", "block").agg(F.sum("weight_b").alias("sum"), F.min(F.struct("h_b", "block_b", "first_b")).alias("near"), F.max((F.col("block") == F.col("block_b")).cast("int")).alias("own"))
    counted = counted.select(F.xxhash64("root", "block").alias("key"), "sum", F.col("near.first_b").alias("tie"), "own")
    certain = dealt.select("key", "fp", "weight").join(counted, "key").select("fp", (F.col("sum") - F.col("weight") * F.col("own")).alias("links"), "tie")
    never = (F.col("most") < F.lit(similarity - ROUNDING) * F.col("least_b")) | (F.col("most_b") < F.lit(similarity - ROUNDING) * F.col("least"))
    asked = durable(pairs.where(~sure & ~never & (F.col("block") <= F.col("block_b"))).select("root", "block", "block_b"), "block-pairs")
    if is_empty(asked):
        return certain
    packed = durable(by_group(dealt.select("key", "root", "block", "of", "weight", "size", "missing", "fp", "diff"), "key", BLOCKS, pack_block, least=1), "packed")
    whole = F.struct(*BLOCKS.names)
    left = packed.select("root", "block", whole.alias("left"))
    right = packed.select("root", F.col("block").alias("block_b"), whole.alias("right"))
    met = asked.join(left, ["root", "block"]).join(right, ["root", "block_b"]).select("left", "right")
    return certain.union(met.mapInArrow(compare_blocks(similarity), T.StructType(LINK)))


def exact_links(texts: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """fp, links (weight of the linked others), tie (one of the set's group) and shared (ties are still to be connected).

    ``texts``: _id and text; ``members``: fp, root, weight, size and rep, an id with a text of this set.
    """
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("parts"), F.min(F.struct("size", "fp")).getField("fp").alias("smallest"))
    sizes = durable(sizes, "cluster-sizes")
    held = spread_join(members, sizes, "root")
    found = texts.join(held, F.col("_id").eqNullSafe(F.col("rep")))
    large, part = F.col("parts") > 1, F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts"))
    copies = F.when(large & (F.col("fp") == F.col("smallest")), F.concat(F.array(F.lit(-1).cast("long")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).otherwise(F.array(F.lit(-1).cast("long")))
    # A row in its own part (-1), and the smallest set once more in each part of a large cluster.
    dealt = found.select("fp", "text", "weight", "root", large.alias("large"), part.alias("part"), F.explode(copies).alias("to"))
    dealt = dealt.select("fp", "text", "weight", "root", "large", (F.col("to") >= 0).alias("first"), F.xxhash64("root", F.when(F.col("to") >= 0, F.col("to")).otherwise(F.col("part"))).alias("key"))
    made = durable(by_group(dealt, "key", COMPARED, compare_cluster(width, similarity)), "compared")
    within = made.where("diff IS NULL").select("fp", "links", "tie", F.lit(False).alias("shared"))
    apart = made.where("diff IS NOT NULL").select("fp", *(f.name for f in APART))
    if is_empty(apart):
        return within
    return within.union(large_links(apart, similarity).select("fp", "links", "tie", F.lit(True).alias("shared")))
