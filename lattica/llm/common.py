"""What several operators share: intermediate tables and word normalisation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.durable import delete, durable, noted_files, shared_folder

__all__ = ["delete", "durable", "noted_files", "shared_folder"]

#: A-Z lower-cased; every other ASCII byte that is no digit or letter becomes a blank; bytes of other characters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


#: Bytes of one Arrow batch between the JVM and Python.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, whose rows may be whole texts of any length, where it has no tighter bound itself."""
    set_now = spark.conf.get(_BATCH)
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(set_now)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def rows_of(batches: Iterator, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
