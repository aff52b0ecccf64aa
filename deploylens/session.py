"""A SparkSession with the defaults this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow batches bounded by their bytes, as rows may hold whole archives."""
    builder = SparkSession.builder.appName("deploylens")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
