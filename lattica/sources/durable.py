"""Intermediate tables in the folder that driver and executors share, and the engine's append-only sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session, as in tests, may do without, and gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Lists of the runs that note their intermediate tables, the innermost last.
_runs: list[list[str]] = []


@contextmanager
def noted_files() -> Iterator[list[str]]:
    """The paths of the intermediate tables made inside, for the caller to ``delete`` once the results are written."""
    files: list[str] = []
    _runs.append(files)
    try:
        yield files
    finally:
        _runs.remove(files)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: a short plan that the loss of executors does not hurt.

    The files go with the application, or when the run that noted them deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    if _runs:
        _runs[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_if_absent(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose key is not there yet, each once; returns what was appended."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        known = spark.read.schema(df.schema).parquet(path).select(*keys).distinct()
        match = [fresh[k].eqNullSafe(known[k]) for k in keys]
        fresh = fresh.join(known, match, "left_anti")
    fresh = durable(fresh, "fresh")
    append(fresh, path)
    return fresh


def canonical_pairs(df: DataFrame, a: str = "entity_a", b: str = "entity_b") -> DataFrame:
    """The smaller end first, no pair of one with itself, each pair once."""
    out = df.withColumns({a: F.least(a, b), b: F.greatest(a, b)}).where(F.col(a) != F.col(b))
    return out.dropDuplicates([a, b])


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, old values stay and only nulls are filled."""
    right = new.select(*(F.col(c).alias(f"_new_{c}") for c in new.columns))
    joined = old.join(right, F.col(key) == F.col(f"_new_{key}"), "full_outer")
    return joined.select(*(F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) for c in old.columns))


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table below ``path`` and return its manifest (table, rows)."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count()))
    manifest = spark.createDataFrame(rows, "table string, rows long")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def orphan_keys(store: DataFrame, blobs: DataFrame, key: str = "object_key") -> DataFrame:
    """Keys of the store that no row knows."""
    return store.select(key).distinct().join(blobs.select(key), key, "left_anti")


def refresh(parts: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Materialise views below ``path``, each in a new folder that its pointer names once all are written.

    Readers that already run keep the old files, so a refresh may overlap with them; a schedule is the caller's.
    """
    stamp = uuid.uuid4().hex
    for name, df in parts.items():
        df.write.parquet(f"{path}/{stamp}/{name}")
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(stamp,)], "stamp string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return refreshed(spark, path, list(parts))


def refreshed(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The views as of the last refresh."""
    stamp = spark.read.schema("stamp string").json(f"{path}/current").first()["stamp"]
    return {name: spark.read.parquet(f"{path}/{stamp}/{name}") for name in names}


def seed(rows: dict[str, list[dict]], paths: dict[str, str], schemas: dict[str, str], keys: dict[str, list[str]], spark: SparkSession) -> dict[str, int]:
    """Load fixture rows (table -> rows) into stored tables, each row once however often it is loaded; new rows by table."""
    counts = {}
    for name, listed in rows.items():
        schema = spark.createDataFrame([], schemas[name]).schema
        made = spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in listed], schema)
        counts[name] = append_if_absent(made, paths[name], keys[name]).count()
    return counts
