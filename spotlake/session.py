"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution re-plans joins from measured shuffle sizes, splits skewed
# shuffle partitions and merges small ones; set `spark.sql.shuffle.partitions` to
# the width of the largest shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "spotlake", master: str | None = None, **extra: str) -> SparkSession:
    """Get or create a session; `extra` keys use `__` where the setting has a dot."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
