"""Session settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Results depend on the first two; the others only steer execution and keep what a cluster already set.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
PREFERRED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "lattica", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that the cluster gives."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = SparkSession.builder.appName(app).master(f"local[{n}]")
    settings = REQUIRED | PREFERRED | {
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": os.environ.get("LATTICA_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on in a session that somebody else made."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
