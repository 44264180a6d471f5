"""Sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "vellum", **conf: str) -> SparkSession:
    """A session (the active one, if there is one): UTC, adaptive execution, and no SQL over
    bare file paths. Further settings by keyword, dots written as double underscores."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.runSQLOnFiles", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
