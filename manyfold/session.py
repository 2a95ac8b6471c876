"""A session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "manyfold", **settings) -> SparkSession:
    """UTC, ANSI SQL and adaptive execution; anything else by ``settings``, dots written as two underscores."""
    builder = SparkSession.builder.appName(name)
    usual = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.aggregatePushdown": "true"}
    return builder.config(map=usual | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
