"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "listenlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and zstd snapshots; ``conf`` overrides with dots written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
