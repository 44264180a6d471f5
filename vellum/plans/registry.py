"""The queries over the driver's tables, each through the operators, and the SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, note_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**graph_queries.QUERIES, **note_queries.QUERIES, **text_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**graph_queries.SQL, **note_queries.SQL, **text_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region by region: the nations, customers and suppliers that lie in it, by the closure of
    the places' edges."""
    return graph_queries.QUERIES["region_members"](spark, sf_dir)
