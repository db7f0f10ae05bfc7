"""Queries of the general data problems: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import timestamps, units
from millrace.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw posting whose posted_date fixes a moment, with that moment."""
    return timestamps.posting_instants(table(spark, sf_dir, "raw_postings"))


def _pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.annual_pay(table(spark, sf_dir, "raw_postings"), table(spark, sf_dir, "jobs"), table(spark, sf_dir, "pay_units"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pay of raw postings and jobs in whole Canadian dollars a year."""
    return _pay(spark, sf_dir).select("rec_table", "rec_id", "salary_min_cad", "salary_max_cad")


def p5_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose unit the forest wasn't sure of, with what was assumed."""
    return _pay(spark, sf_dir).where(F.col("route") == "review").select("rec_table", "rec_id", "salary_min_cad", "salary_max_cad", "unit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {f.__name__: f for f in (p3_found, p5_found, p5_review)}
