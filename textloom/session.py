"""A Spark session with the settings this library is built for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "textloom", **conf: str) -> SparkSession:
    """The running session, or a new one: adaptive execution with skew splitting, UTC, Arrow transfer. conf overrides; dots in keys are written as __."""
    builder = SparkSession.builder.appName(name)
    held = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in held.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
