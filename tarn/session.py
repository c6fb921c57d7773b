"""The Spark session the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tarn", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are the cluster's or ``conf``'s."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
