"""Session with the settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Parsing is CPU-bound: smaller splits of page tables give more tasks.
    "spark.sql.files.maxPartitionBytes": "64m",
}


def build(app: str = "pageprism", **extra: str) -> SparkSession:
    """A session; on a cluster the master and the checkpoint folder come from outside."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
