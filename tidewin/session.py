"""Session builder with the settings that the engine relies on."""
from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewin", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew handling, Arrow; anything in ``conf`` (dots as double underscores) wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
