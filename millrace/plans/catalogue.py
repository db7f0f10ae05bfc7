"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import data_queries, scalar_queries, store_queries

BOOKS = (scalar_queries.BOOK, store_queries.BOOK)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    out = {}
    for book in BOOKS:
        out |= book.queries
    return out | data_queries.queries()


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    out = {}
    for book in BOOKS:
        out |= book.sql
    return out
