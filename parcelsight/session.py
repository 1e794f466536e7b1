"""Session settings every job relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime settings; safe to apply to a session somebody else built.
RUNTIME_CONF = {
    # elapsed days and weekdays are computed in UTC whatever the host says
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot city / seller / product is split even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(name: str = "parcelsight", cores: int | str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cores = cores or os.environ.get("BENCH_CPUS") or "8"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
