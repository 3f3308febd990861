"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "docloom", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; anything else comes from the cluster or from conf."""
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
