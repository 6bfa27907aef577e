"""Joins and groups where one key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot beyond a quarter of a task's even share of the rows, but never below this many.
LEAST_HOT = 1000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys with more than a quarter of a task's share: by counting, at most four for each shuffle partition."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    if total <= LEAST_HOT:
        return None
    hot = [r[0] for r in counts.where((F.col("_n") > max(total // (4 * tasks), LEAST_HOT)) & F.col(key).isNotNull()).select(key).collect()]
    return rows.sparkSession.createDataFrame([(k,) for k in hot], T.StructType([rows.schema[key]])) if hot else None


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows.join(table, key, how)`` for a table with one row for each key; how is inner, left or left_semi.

    Rows of hot keys stay where they are and meet the few table rows of those keys as a broadcast, at most four for each
    shuffle partition; all other rows are shuffled. ``rows`` is read twice and counted, so it had better be written.
    """
    hot = hot_keys(rows, key)
    if hot is None:
        return rows.join(table, key, how)
    some = table.join(F.broadcast(hot), key, "left_semi")
    here = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(some), key, how)
    return here.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def grouped(batches: Iterator[pa.RecordBatch], key: str, least: int = 2) -> Iterator[pa.Table]:
    """Rows of equal ``key`` from a partition that is sorted by it, groups of fewer than ``least`` rows left out."""
    rest: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.Table]:
        if rest and sum(b.num_rows for b in rest) >= least:
            yield pa.Table.from_batches(rest)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        if rest and rest[0].column(rest[0].schema.names.index(key))[0].as_py() != keys[0]:
            yield from whole()
            rest = []
        at = 0
        for cut in [*(k + 1 for k in range(len(keys) - 1) if keys[k] != keys[k + 1]), len(keys)] if keys.dtype == object else [*((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]:
            if at:
                yield from whole()
                rest = []
            rest.append(batch.slice(at, cut - at))
            at = cut
    yield from whole()


def by_group(rows: DataFrame, key: str, schema: T.StructType, work: Callable[[pa.Table], pa.RecordBatch | None], least: int = 2) -> DataFrame:
    """``work`` on each group of ``least`` rows or more; a partition's groups stream through one Python call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, key, least):
            made = work(group)
            if made is not None:
                yield made

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
