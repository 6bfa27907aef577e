"""Incremental consolidation: captured experiences wait, are picked, extracted, written and completed, or retried.

The queue is a state table; each micro-batch picks what is due and returns the next state, so that a checkpointed stream
gives each batch its effect once. Extraction is a seam: any function from a frame of experiences to one of claims.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.durable import append

#: Of the queue.
ATTEMPTS, STALE_MINUTES, BACKOFF_MINUTES, BATCH = 3, 15, (5, 30), 50
#: The predicate vocabulary, and what supports a claim.
PREDICATES = """knows met_at mentored_by reports_to introduced_by owns works_at used_to_work_at founded invested_in partnered_with said wrote recommended discussed
believes prefers decided_to working_on interested_in blocked_by attended lives_in happened_at other""".split()
SUPPORT = ["verbatim", "paraphrased", "inferred"]
CLAIM = T.StructType([*(T.StructField(n, T.StringType()) for n in ("subject", "subject_kind", "predicate", "predicate_detail", "object", "object_kind", "support_kind")), T.StructField("confidence", T.DoubleType())])


def reclaimed(queue: DataFrame, now: Column) -> DataFrame:
    """What has been in progress too long waits again; the attempt is not charged."""
    stale = (F.col("status") == "in_progress") & (F.col("attempted_at") < now - F.make_dt_interval(mins=F.lit(STALE_MINUTES)))
    return queue.withColumns({"attempts": F.when(stale, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")), "status": F.when(stale, "pending").otherwise(F.col("status"))})


def due(queue: DataFrame, now: Column) -> Column:
    wait = F.when(F.col("attempts") <= 1, BACKOFF_MINUTES[0]).otherwise(BACKOFF_MINUTES[1])
    rested = F.col("attempted_at").isNull() | (F.col("attempts") == 0) | (F.col("attempted_at") <= now - F.make_dt_interval(mins=wait))
    return (F.col("status") == "pending") & (F.col("attempts") < ATTEMPTS) & rested


def picked(queue: DataFrame, now: Column, limit: int = BATCH) -> DataFrame:
    """The ids of the next batch: those never tried first, then oldest."""
    return queue.where(due(queue, now)).orderBy(F.asc_nulls_first("attempted_at"), "captured_at", "id").limit(limit).select("id")


def started(queue: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    rows = queue.join(batch.select("id", F.lit(True).alias("_go")), "id", "left")
    go = F.coalesce("_go", F.lit(False))
    return rows.withColumns({"status": F.when(go, "in_progress").otherwise(F.col("status")), "attempts": F.when(go, F.col("attempts") + 1).otherwise(F.col("attempts")), "attempted_at": F.when(go, now).otherwise(F.col("attempted_at"))}).drop("_go")


def finished(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes (id, ok): complete, or pending again, or failed after the last attempt. Only what is in progress changes."""
    rows = queue.join(outcomes, "id", "left")
    mine = (F.col("status") == "in_progress") & F.col("ok").isNotNull()
    after = F.when(F.col("ok"), "complete").when(F.col("attempts") >= ATTEMPTS, "failed").otherwise("pending")
    return rows.withColumn("status", F.when(mine, after).otherwise(F.col("status"))).drop("ok")


def exhausted(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when((F.col("status") == "pending") & (F.col("attempts") >= ATTEMPTS), "failed").otherwise(F.col("status")))


def parsed_claims(raw: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Valid claims of JSON arrays, and rejected ones with the reason."""
    items = raw.withColumn("_items", F.from_json(column, T.ArrayType(CLAIM)))
    rows = items.select(*raw.columns, F.explode_outer("_items").alias("claim")).select(*raw.columns, "claim.*")
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.withColumns({c: empty(c) for c in ("subject", "object", "predicate_detail")})
    reason = (
        F.when(F.col("predicate").isNull() & F.col("subject").isNull(), "unreadable").when(F.col("subject").isNull(), "no subject").when(F.col("object").isNull(), "no object")
        .when(~F.col("predicate").isin(PREDICATES), "unknown predicate").when((F.col("predicate") == "other") & F.col("predicate_detail").isNull(), "other without detail")
        .when(~F.col("support_kind").isin(SUPPORT), "unknown support").when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence out of range")
    )
    judged = rows.withColumn("reason", F.coalesce(reason, F.when(F.col("predicate").isNull() | F.col("support_kind").isNull(), "incomplete")))
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def parsed_anchor(raw: DataFrame) -> DataFrame:
    """Temporal anchors (at, window_start, window_end, confidence as text) with ``valid``: at most one of moment and window, times that parse, confidence within 0 to 1."""
    times = {c: F.try_to_timestamp(c) for c in ("at", "window_start", "window_end")}
    readable = [F.col(c).isNull() | t.isNotNull() for c, t in times.items()]
    single = ~(F.col("at").isNotNull() & (F.col("window_start").isNotNull() | F.col("window_end").isNotNull()))
    ordered = F.coalesce(times["window_start"] <= times["window_end"], F.lit(True))
    sure = F.col("confidence").isNull() | F.coalesce(F.expr("try_cast(confidence AS double)").between(0, 1), F.lit(False))
    valid = single & ordered & sure
    for r in readable:
        valid = valid & r
    return raw.withColumn("valid", valid)


def consolidate_stream(spark: SparkSession, source: str, schema: T.StructType, extract: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = True):
    """Stream captured experiences through ``extract`` (id, payload) and append valid and rejected claims below ``sink``.

    Each batch writes to a folder of its own number, which a repeated batch overwrites: exactly once without locks.
    """

    def batch(df: DataFrame, number: int) -> None:
        good, bad = parsed_claims(extract(df.dropDuplicates(["id"])))
        good.write.mode("overwrite").parquet(f"{sink}/claims/batch={number}")
        bad.write.mode("overwrite").parquet(f"{sink}/rejected/batch={number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 minutes")).start()


def capture_batch(df: DataFrame, path: str) -> None:
    """Captured rows always start out pending."""
    append(df.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "attempted_at": F.lit(None).cast("timestamp"), "visibility": F.coalesce("visibility", F.lit("private"))}), path)

