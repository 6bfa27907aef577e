"""Best-fit packing of documents into sequences of a fixed number of tokens.

One pass encodes every text and cuts only what is too long; of each piece only its length and checksum go on. The
lengths' histogram, at most one entry per possible length, is packed on the driver by bin completion
(:mod:`lattica.llm.bins`). A pattern takes a run of consecutive ranks of each of its lengths, so that a piece finds
its sequence from its rank among the pieces of its length: ranks are the pieces' numbers within their partition, given
while they are made, plus the counts of the partitions before. No task ever holds the pieces of one length together.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.bins import pack_lengths
from lattica.llm.common import durable, small_batches
from lattica.llm.tokens import default_folder, encoder

CAPACITY, END_ID = 1024, 2
#: Counts by length and partition, of 24 bytes, up to which they are broadcast.
MAX_BROADCAST = 200_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, folder: str, keep_ids: bool) -> DataFrame:
    """A row for each piece, with the partition that made it and its number there among those of its length."""
    fields = [
        docs.schema[id_col],
        T.StructField("piece", T.IntegerType()),
        *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")),
        T.StructField("part", T.IntegerType()),
        T.StructField("nth", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
    ]
    end = int(end_id).to_bytes(4, "little")
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(folder), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids = batch.column(batch.schema.names.index(id_col))
            whose, rows = [], []
            for k, text in enumerate(batch.column(batch.schema.names.index(text_col)).to_pylist()):
                tokens = memoryview(enc.ids(text) + end)
                for piece, (start, length) in enumerate(cut(len(tokens) // 4, capacity)):
                    own = tokens[4 * start : 4 * (start + length)]
                    whose.append(k)
                    rows.append((piece, start, length, zlib.crc32(own), part, seen[length], *([bytes(own)] if keep_ids else [])))
                    seen[length] += 1
            columns = [ids.take(pa.array(whose, pa.int64())), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence, pieces of this length in each sequence, first offset."""
    taken: Counter = Counter()
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for filling, times in patterns:
        offset = 0
        for length, n in sorted(Counter(filling).items(), reverse=True):
            out.setdefault(length, []).append((taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for length, runs in out.items()}


def place(found: DataFrame, plan: dict[int, tuple[np.ndarray, ...]]) -> DataFrame:
    """``found`` with sequence_id and offset in place of length's rank."""
    held = found.sparkSession.sparkContext.broadcast(plan)  # a few runs for each pattern, of which there are few per length
    kept = [f for f in found.schema.fields if f.name != "rank"]
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names
            length, rank = (batch.column(at.index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                first, base, n, begin = held.value[int(size)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                more = rank[rows] - first[k]
                sequence[rows] = base[k] + more // n[k]
                offset[rows] = begin[k] + more % n[k] * size
            columns = [batch.column(at.index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[f.name for f in [*kept, *added]])

    return found.mapInArrow(run, T.StructType([*kept, *added]))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_folder: str | None = None, keep_ids: bool = True) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset and, with ``keep_ids``, ids (binary, little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    made = durable(pieces(docs, id_col, text_col, capacity, end_id, tokenizer_folder or default_folder(), keep_ids), "pieces")
    counted = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    counted = durable(counted, "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    # A window holds one row for each partition.
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counted.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    few = counted.count() <= MAX_BROADCAST
    ranked = made.join(F.broadcast(offsets) if few else offsets.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    order = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "rank"]
    return place(ranked.select(*order), slots(pack_lengths(histogram, capacity)))
