"""Ranked lists and lookups over stored postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.fields import literal_map

STATE_ORDER = {"new": 0, "reviewed": 1, "applied": 2, "dismissed": 3}
UNCLASSIFIED = "Unclassified"


def feed_order() -> list[Column]:
    """Latest first, then best paid, unknowns last; job_id settles ties."""
    return [F.desc_nulls_last("posted_at"), F.desc_nulls_last("salary_min_cad"), F.asc("job_id")]


def list_jobs(jobs: DataFrame, user_id: str, state: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of a user's jobs: those of ``state``, or all that aren't dismissed."""
    mine = jobs.where(F.col("user_id") == user_id)
    mine = mine.where(F.col("state") == state) if state else mine.where(F.col("state") != "dismissed")
    return mine.orderBy(*feed_order()).offset(offset).limit(limit)


def with_specialty(jobs: DataFrame, classifications: DataFrame) -> DataFrame:
    """jobs with ``specialty``, Unclassified where there is none."""
    names = classifications.select("job_id", F.col("specialty_name").alias("specialty"))
    return jobs.join(names, "job_id", "left").withColumn("specialty", F.coalesce("specialty", F.lit(UNCLASSIFIED)))


def canonical_label(jobs: DataFrame) -> DataFrame:
    """(job_id, canonical_label) of duplicates: title and company of what they repeat, else the start of its id."""
    other = jobs.select(F.col("job_id").alias("duplicate_of"), F.concat(F.col("title"), F.lit(" at "), F.col("company_normalized")).alias("label"))
    return jobs.where("duplicate_of IS NOT NULL").select("job_id", "duplicate_of").join(other, "duplicate_of", "left").select("job_id", F.coalesce("label", F.substring("duplicate_of", 1, 12)).alias("canonical_label"))


def feed_sorted(jobs: DataFrame, classifications: DataFrame, user_id: str, limit: int = 200) -> DataFrame:
    """The feed's second sort: open states first, then by date and pay; ties keep the first order. Applied and dismissed rows leave."""
    page = list_jobs(jobs, user_id, limit=limit)
    shown = with_specialty(page, classifications).where(~F.col("state").isin("applied", "dismissed"))
    rank = F.coalesce(F.try_element_at(literal_map(STATE_ORDER), F.col("state")), F.lit(9))
    day = F.coalesce(F.date_format("posted_at", "yyyyMMdd").cast("int"), F.lit(0))
    return shown.orderBy(rank, F.desc(day), F.desc(F.coalesce("salary_min_cad", F.lit(0))), *feed_order())


def list_signals(events: DataFrame, user_id: str, job_id: str | None = None, as_of: str | None = None, window_days: int | None = None) -> DataFrame:
    """A user's events, latest first, of one job and of the last days if asked."""
    mine = events.where(F.col("user_id") == user_id)
    if job_id:
        mine = mine.where(F.col("job_id") == job_id)
    if window_days:
        mine = mine.where(F.col("recorded_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(window_days)))
    return mine.orderBy(F.desc("recorded_at"), F.desc("event_id"))
