"""Salience as a stream: decayed recall weights by target in windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.aggregates import OUTCOMES, SALIENCE_SCALE_DAYS


def weight() -> Column:
    return F.when(F.col("outcome") == "helpful", OUTCOMES["helpful"]).when(F.col("outcome") == "wrong", OUTCOMES["wrong"]).otherwise(0.0)


def windowed(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Per target and window: recalls and their weights, decayed to the window's end. Works on streams and on tables."""
    window = F.window("recalled_at", width)
    age = (F.unix_micros(window["end"].cast("timestamp")) - F.unix_micros(F.col("recalled_at").cast("timestamp"))) / 1e6
    marked = events.withWatermark("recalled_at", late) if events.isStreaming else events
    grouped = marked.groupBy(window.alias("window"), "target_kind", "target_id")
    return grouped.agg(F.count("*").alias("recalls"), F.sum(weight() * F.exp(-age / (SALIENCE_SCALE_DAYS * 86400))).alias("at_end"))


def from_windows(windows: DataFrame, now: Column) -> DataFrame:
    """The salience at ``now`` from closed windows: decay is multiplicative, so sums at window ends are enough."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("window.end").cast("timestamp"))) / 1e6
    return windows.groupBy("target_kind", "target_id").agg(F.sum(F.col("at_end") * F.exp(-age / (SALIENCE_SCALE_DAYS * 86400))).alias("salience"))
