"""N-gram Jaccard self-join by chosen paths (Christiani, Pagh, Sivertsen 2018).

Texts are sets of five-word shingles. Equal sets are one node with a weight, so copies cost one row each and no pairs.

1. A node's set is embedded by minwise hashing: its tokens are (coordinate, value). In each run one coordinate is sampled
   at the root, and nodes that share its token meet in a bucket.
2. Buckets are split recursively, inside the task that holds them: each path samples a coordinate, and with probability
   1/4 a second one, so that a pair at 0.8 has one child in common on average. A bucket is compared by brute force once
   the pairs that its first node leaves open are at most ``PAIRS``; a group of near copies, which no split takes apart,
   leaves few. Nodes estimated at ``ESTIMATE`` or more are connected and tied to the first of their group, a number of
   rows linear in the bucket.
3. A bucket of more than ``TASK_NODES`` nodes is dealt over several tasks, each with the bucket's first node. Nodes that
   a task does not connect with it are open; if they are few they visit all the bucket's tasks, else the bucket is split
   by its path as above. No bucket is capped.
4. Runs are repeated, ``RUNS`` at a time, until of the similar pairs of ``SAMPLE`` nodes with all nodes, as estimated from
   coordinates that no first run samples, ``RECALL`` are connected.
5. Connected ties are clusters, in which all pairs are compared exactly. In a large cluster a set is its difference from
   the cluster's smallest set, so texts are read once, and blocks of nodes whose distances from that set already decide
   are counted without comparing. Links are counted where they are found and groups come out as ties: no pair is ever a row.

Defined results: texts without words have no links and are groups of their own, as are null texts; repeated rows are
copies of each other; ids may repeat or be null; the group's id is its smallest id; other columns are not looked at.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import durable, is_empty, small_batches
from lattica.llm.components import components
from lattica.llm.exact_links import exact_links
from lattica.llm.shingles import fingerprint, shingles
from lattica.llm.spread import by_group, spread_join

SIMILARITY = 0.8
COORDINATES, RUNS, RECALL, SAMPLE = 64, 8, 0.95, 512
#: Repetitions that find no more pairs mean that the estimate is above what can be found.
MAX_REPEATS = 8
#: Pairs of a bucket compared at once, and nodes of one bucket in a task: 10 MB of sketches.
PAIRS, TASK_NODES = 1 << 22, 65_536
#: Four standard errors below the similarity.
ESTIMATE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5

_random = np.random.default_rng(20180401)
_MULTIPLY = _random.integers(0, 1 << 31, COORDINATES, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _random.integers(0, 1 << 32, COORDINATES, np.uint32)


def sketch(own: np.ndarray) -> tuple[list[int], bytes]:
    """The shingles that are smallest in the first runs' coordinates, and 16 bits of the minimum in every coordinate."""
    low = (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    roots, values = [], np.empty(COORDINATES, np.uint32)
    for i in range(COORDINATES):
        v = low * _MULTIPLY[i] + _ADD[i]
        if i < RUNS:
            k = int(v.argmin())
            roots.append(int(own[k].astype(np.int64)))
            values[i] = v[k]
        else:
            values[i] = v.min()
    return roots, (values ^ values >> np.uint32(16)).astype("<u2").tobytes()


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, fp (null without words), size, roots, sk for every row."""
    schema = T.StructType([
        docs.schema[id_col],
        T.StructField("fp", T.BinaryType()),
        T.StructField("size", T.LongType()),
        T.StructField("roots", T.ArrayType(T.LongType())),
        T.StructField("sk", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.names.index(text_col)).to_pylist():
                own = shingles(text, width)
                rows.append((fingerprint(own), len(own), *(sketch(own) if len(own) else (None, None))))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(id_col)), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


#: A name that no column of the documents has.
FP = "_lattica_fp"


def with_fingerprint(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """``docs`` with the fingerprint of each row's shingles."""
    schema = T.StructType([*docs.schema.fields, T.StructField(FP, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(shingles(t, width)) for t in batch.column(batch.schema.names.index(text_col)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return docs.mapInArrow(run, schema)


def alike(sk: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sk == one).sum(1) >= ESTIMATE * COORDINATES


class Groups:
    """Disjoint sets of 0..n-1; the smallest member stands for its set."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def first(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def unite(self, i: int, more: list[int]) -> None:
        i = self.first(i)
        for j in map(self.first, more):
            i, j = min(i, j), max(i, j)
            self.up[j] = i


def connect(sk: np.ndarray, rows: np.ndarray, groups: Groups) -> None:
    """Connects all similar pairs among ``rows``; a row that is reached is compared only with those not reached yet."""
    rest, left = rows, sk[rows]
    while len(rest) > 1:
        begin = int(rest[0])
        todo = [begin]
        rest, left = rest[1:], left[1:]
        while todo and len(rest):
            near = alike(left, sk[todo.pop()])
            if near.any():
                hits = rest[near].tolist()
                groups.unite(begin, hits)
                todo.extend(hits)
                rest, left = rest[~near], left[~near]


def split(sk: np.ndarray, path: int) -> Groups:
    """The groups that chosen paths connect in one bucket."""
    groups = Groups(len(sk))
    todo = [(np.arange(len(sk)), path)]
    while todo:
        rows, path = todo.pop()
        n = len(rows)
        if n * (n - 1) // 2 > PAIRS and n * int((~alike(sk[rows], sk[rows[0]])).sum()) > PAIRS:
            more = hash((path, 2))
            for c in {hash((path, 1)) % COORDINATES, *([more // 4 % COORDINATES] if more % 4 == 0 else [])}:
                order = rows[np.argsort(sk[rows, c], kind="stable")]
                values = sk[order, c]
                for part in np.split(order, np.flatnonzero(values[1:] != values[:-1]) + 1):
                    if len(part) > 1:
                        todo.append((part, hash((path, c, int(sk[part[0], c])))))
        elif n > 1:
            connect(sk, rows, groups)
    return groups


TIE = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])
#: Ties, and the open nodes of a bucket with its path.
FOUND = T.StructType([*TIE.fields, T.StructField("path", T.LongType()), T.StructField("sk", T.BinaryType())])


def sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


def in_order(group: pa.Table) -> pa.Table:
    """By fingerprint, so that results do not depend on the order of arrival."""
    fps = group.column("fp").to_pylist()
    return group.take(sorted(range(len(fps)), key=fps.__getitem__))


def tie_bucket(group: pa.Table) -> pa.RecordBatch | None:
    """Nodes of a bucket tied to the first of their group."""
    group = in_order(group)
    fp = group.column("fp").to_pylist()
    groups = split(sketches(group.column("sk").to_pylist()), group.column("path")[0].as_py())
    ties = [(fp[r], fp[i]) for i in range(len(fp)) if (r := groups.first(i)) != i]
    return pa.RecordBatch.from_arrays([pa.array([t[k] for t in ties], pa.binary()) for k in (0, 1)], names=TIE.names) if ties else None


def tie_part(group: pa.Table) -> pa.RecordBatch:
    """A part of a bucket with the bucket's first node: ties, and the nodes that are not connected with that one."""
    group = in_order(group)
    fp, sk, path = group.column("fp").to_pylist(), group.column("sk").to_pylist(), group.column("path")[0].as_py()
    pivot = group.column("first")[0].as_py()
    fp, sk = [pivot["fp"], *fp], [pivot["sk"], *sk]
    groups = split(sketches(sk), path)
    rows = [(fp[r], fp[i], None, None) for i in range(len(fp)) if (r := groups.first(i)) != i]
    rows += [(fp[i], fp[i], path, sk[i]) for i in range(len(fp)) if groups.first(i) != 0 and fp[i] != fp[0]]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.binary()))], names=FOUND.names)


def tie_visitors(group: pa.Table) -> pa.RecordBatch | None:
    """Open nodes tied to all similar ones of a part of their bucket."""
    group = in_order(group)
    fp, sk, visits = group.column("fp").to_pylist(), sketches(group.column("sk").to_pylist()), group.column("visits").to_pylist()
    ties = [(fp[i], fp[j]) for i in range(len(fp)) if visits[i] for j in np.flatnonzero(alike(sk, sk[i])).tolist() if fp[i] != fp[j]]
    return pa.RecordBatch.from_arrays([pa.array([t[k] for t in ties], pa.binary()) for k in (0, 1)], names=TIE.names) if ties else None


def value(coordinate: Column) -> Column:
    return F.substring("sk", (coordinate * 2 + 1).cast("int"), F.lit(2))


def root_rows(nodes: DataFrame, repeat: int) -> DataFrame:
    """path, fp, sk of every node in each run: the first runs by whole shingles, later ones by two coordinates' values."""
    if repeat == 0:
        rows = nodes.select("fp", "sk", F.posexplode("roots").alias("run", "token"))
        return rows.select(F.xxhash64("run", "token").alias("path"), "fp", "sk")
    chosen = np.random.default_rng(repeat).permutation(COORDINATES)[: 2 * RUNS].reshape(-1, 2).tolist()
    paths = F.array(*(F.xxhash64(F.lit(repeat * RUNS + k), value(F.lit(a)), value(F.lit(b))) for k, (a, b) in enumerate(chosen)))
    return nodes.select(F.explode(paths).alias("path"), "fp", "sk")


def ties(nodes: DataFrame, repeat: int) -> DataFrame:
    """(u, v) for similar nodes that meet in one of the runs, connected rather than all."""
    rows = root_rows(nodes, repeat)
    made = []
    for level in range(COORDINATES):
        large = rows.groupBy("path").agg(F.count("*").alias("n"), F.min_by(F.struct("fp", "sk"), F.xxhash64("fp", "path")).alias("first"))
        large = durable(large.where(F.col("n") > TASK_NODES), "large-buckets")
        if is_empty(large):
            return union([*made, by_group(rows, "path", TIE, tie_bucket)])
        held = durable(spread_join(rows, large, "path", "left"), "bucket-rows")
        made.append(by_group(held.where("n IS NULL").select("path", "fp", "sk"), "path", TIE, tie_bucket))
        parts = F.ceil(F.col("n") / TASK_NODES)
        dealt = held.where("n IS NOT NULL").withColumn("key", F.xxhash64("path", F.pmod(F.xxhash64("fp", F.lit(7)), parts)))
        found = durable(by_group(dealt, "key", FOUND, tie_part, least=1), "bucket-parts")
        made.append(found.where("path IS NULL").select("u", "v"))
        opened = found.where("path IS NOT NULL").select("path", F.col("u").alias("fp"), "sk")
        few = large.join(opened.groupBy("path").agg(F.count("*").alias("open")), "path").select("path", F.col("n").alias("of"), (16 * F.col("open") * parts <= F.col("n")).alias("few"))
        few = durable(few, "open-buckets")
        visitors = spread_join(opened, few.where("few"), "path").select("path", "fp", "sk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("of") / TASK_NODES) - 1)).alias("part"))
        visitors = visitors.select("fp", "sk", F.xxhash64("path", "part").alias("key"), F.lit(True).alias("visits"))
        kinds = spread_join(dealt, few, "path")
        hosts = kinds.where("few").select("fp", "sk", "key", F.lit(False).alias("visits"))
        made.append(by_group(hosts.union(visitors), "key", TIE, tie_visitors))
        at = lambda j: F.pmod(F.xxhash64("path", F.lit(level), F.lit(j)), F.lit(COORDINATES))  # noqa: E731, B023
        child = lambda j: F.xxhash64("path", at(j), value(at(j)))
        children = F.when(F.pmod(F.xxhash64("path", F.lit(level), F.lit(2)), F.lit(4)) == 0, F.array_distinct(F.array(child(0), child(1)))).otherwise(F.array(child(0)))
        rows = durable(kinds.where("NOT few").select(F.explode(children).alias("path"), "fp", "sk"), "child-buckets")
    raise RuntimeError("a bucket does not split")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def recall(nodes: DataFrame, members: DataFrame) -> float:
    """Of the similar pairs of ``SAMPLE`` nodes with all nodes, the share that ``members`` (fp, root) connect.

    Fingerprints are uniform, so the smallest are a sample. Similarity is estimated from coordinates that no first run samples.
    """
    asked = nodes.select("fp", "sk").orderBy("fp").limit(SAMPLE).collect()
    fps = [bytes(r["fp"]) for r in asked]
    of = {bytes(r["fp"]): bytes(r["root"]) for r in members.where(F.col("fp").isin(fps)).collect()} if fps else {}
    want = sketches([bytes(r["sk"]) for r in asked])[:, RUNS:] if fps else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = found = 0
        for batch in batches:
            if batch.num_rows:
                fp, root = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                sk = np.ascontiguousarray(sketches(batch.column(1).to_pylist())[:, RUNS:])
                for k, one in enumerate(fps):
                    for i in np.flatnonzero((sk == want[k]).sum(1) >= SIMILARITY * (COORDINATES - RUNS)).tolist():
                        pairs += fp[i] != one
                        found += fp[i] != one and root[i] is not None and root[i] == of.get(one)
        yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([found])], names=["pairs", "found"])

    rows = nodes.select("fp", "sk").join(members.select("fp", "root"), "fp", "left")
    sums = rows.mapInArrow(run, "pairs long, found long").agg(F.sum("pairs").alias("pairs"), F.sum("found").alias("found")).first()
    return sums["found"] / sums["pairs"] if sums["pairs"] else 1.0


def clusters(nodes: DataFrame) -> DataFrame:
    """(fp, root) of the nodes that are tied to others; runs are repeated until the target recall."""
    edges, members = None, None
    for repeat in range(MAX_REPEATS):
        more = ties(nodes, repeat)
        edges = more if edges is None else edges.union(members.select(F.col("fp").alias("u"), F.col("root").alias("v"))).union(more)
        members = durable(components(edges).select(F.col("node").alias("fp"), "root"), "clusters")
        reached = recall(nodes, members)
        if reached >= RECALL:
            return members
    warnings.warn(f"near duplicates: {reached:.3f} of the sampled pairs are connected after {MAX_REPEATS * RUNS} runs", stacklevel=2)
    return members


#: Bits of the filter of possible members, 64 in a row: at most 131,072 rows, 2 MB, whatever the corpus' size.
FILTER_BITS = 23


def possible(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` without most of those whose _id no member has, so that a join with the members moves few other texts.

    A bitmap of hashes: members always pass; the more there are the more others do, too, which costs time only.
    """
    at = F.pmod(F.xxhash64("_id"), F.lit(1 << FILTER_BITS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    bits = members.select(at.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("word")).agg(F.bit_or(bit(F.col("h"))).alias("bits"))
    bits = durable(bits, "member-bits")
    marked = rows.withColumn("h", at).withColumn("word", F.floor(F.col("h") / 64))
    return marked.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit(F.col("h"))) != 0).select(*rows.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """For every row of ``docs``: id, class_id (the group's smallest id), n_links (other rows at ``similarity`` or more), group and fp (binary; null without words)."""
    small_batches(docs.sparkSession)
    rows = durable(sketched(docs, id_col, text_col, width), "sketches")
    nodes = durable(
        rows.where(F.col("fp").isNotNull())
        .groupBy("fp")
        .agg(F.count("*").alias("weight"), F.min(id_col).alias("rep"), F.first("size").alias("size"), F.first("roots").alias("roots"), F.first("sk").alias("sk")),
        "nodes",
    )
    members = durable(clusters(nodes).join(nodes.select("fp", "weight", "rep", "size"), "fp"), "members")
    texts = possible(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), members.select(F.col("rep").alias("_id")))
    links = durable(exact_links(texts, members, width, similarity), "links")
    counted = links.groupBy("fp").agg(F.sum("links").alias("links"))
    classes = links.where(~F.col("shared")).select("fp", F.col("tie").alias("root"))
    shared = links.where(F.col("shared") & F.col("tie").isNotNull()).select(F.col("fp").alias("u"), F.col("tie").alias("v"))
    if not is_empty(shared):
        classes = classes.union(components(shared).select(F.col("node").alias("fp"), "root"))
    linked = durable(classes.join(nodes.select("fp", "rep"), "fp"), "linked")
    first = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = spread_join(linked, first, "root").select("fp", "root", "class_id").join(counted, "fp")
    of_node = nodes.select("fp", "weight", "rep").join(known, "fp", "left")
    of_node = of_node.select(
        "fp", F.coalesce("root", "fp").alias("group"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = spread_join(rows.select(id_col, "fp"), durable(of_node, "classes"), "fp", "left")
    return out.select(id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group", "fp")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group, with the smallest id, and every row without words."""
    found = near_duplicates(docs, id_col, text_col, width, similarity).where(F.col("fp").isNotNull() & F.col(id_col).eqNullSafe(F.col("class_id")))
    # Texts of one group may share an id, and a row may be repeated: one of them stays.
    texts = found.groupBy("group", F.col(id_col).alias("_lattica_id"), "fp").agg(F.count("*").alias("n"))
    keep = durable(texts.groupBy("group", "_lattica_id").agg(F.min(F.struct("fp", "n")).alias("x")).select("_lattica_id", F.col("x.fp").alias("_lattica_kept"), F.col("x.n").alias("_lattica_n")), "keep")
    rows = with_fingerprint(docs, text_col, width)
    rows = rows.join(keep, F.col(id_col).eqNullSafe(F.col("_lattica_id")) & (F.col(FP) == F.col("_lattica_kept")), "left")
    n = F.col("_lattica_n")
    out = rows.where(F.col(FP).isNull() | (n == 1))
    if not is_empty(keep.where("_lattica_n > 1")):
        out = out.union(rows.where(n > 1).dropDuplicates([id_col, FP]))
    return out.select(*docs.columns)
