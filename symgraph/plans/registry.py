"""Queries and their SQL, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, index_queries, text_queries  # noqa: F401  (all add to QUERIES and SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(graph_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(graph_queries.SQL)
