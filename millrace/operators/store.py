"""Mutations as functions of old table and changes; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut


def first_rows(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``: an aggregate, combined before the shuffle, so a hot key is no problem."""
    ranked = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    return rows.groupBy(*keys).agg(F.min(ranked).alias("_first")).select("_first._row.*")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The rows of ``new`` that enter ``old``: the first of each key, unless the key is there."""
    return first_rows(new, keys, order).join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, changed: list[str]) -> DataFrame:
    """``old`` after ``new``: columns in ``changed`` taken from the new row, all others kept; new keys added."""
    other = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key], F.lit(True).alias("_hit"))
    joined = old.withColumn("_had", F.lit(True)).join(other, key, "full_outer")
    hit, had = F.col("_hit").isNotNull(), F.col("_had").isNotNull()
    out = [F.col(key)]
    for c in old.columns:
        if c != key:
            fresh = F.col(f"_new_{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
            out.append((F.when(hit, fresh).otherwise(F.col(c)) if c in changed else F.when(had, F.col(c)).otherwise(fresh)).alias(c))
    return joined.select(*out)


def apply_duplicates(jobs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """jobs with duplicate_of set by the last audit row of each."""
    last = duplicates.groupBy(F.col("duplicate_post_id").alias("job_id")).agg(F.max_by("canonical_post_id", "duplicate_id").alias("_canonical"))
    return jobs.join(last, "job_id", "left").withColumn("duplicate_of", F.coalesce("_canonical", "duplicate_of")).drop("_canonical")


def delete_user(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    """What is left of jobs, duplicates, classifications and signal_events after a user's jobs are deleted."""
    gone = tables["jobs"].where(F.col("user_id") == user_id).select("job_id")
    d = tables["duplicates"]
    for side in ("duplicate_post_id", "canonical_post_id"):
        d = d.join(gone.withColumnRenamed("job_id", side), side, "left_anti")
    s = tables["signal_events"]
    own = s.where(F.col("user_id").eqNullSafe(F.lit(user_id))).join(gone, "job_id", "left_anti")
    return {
        "jobs": tables["jobs"].where(~F.col("user_id").eqNullSafe(F.lit(user_id))),
        "classifications": tables["classifications"].where(~F.col("user_id").eqNullSafe(F.lit(user_id))),
        "duplicates": d,
        "signal_events": s.where(~F.col("user_id").eqNullSafe(F.lit(user_id))).unionByName(own),
    }


def next_ids(rows: DataFrame, start: int, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` numbered from ``start`` + 1 in ``order``, by counts of range partitions instead of one global window.

    The sorted rows are written out first, since counts and rows must see the
    same partitions; the offsets sent to every task are a row a partition.
    """
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    first = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = first.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_low", "_offset")
    return parts.join(F.broadcast(offset), "_part").withColumn(name, F.lit(start) + F.col("_offset") + (F.col("_at") - F.col("_low")) + 1).drop("_part", "_at", "_low", "_offset")


def single_active(documents: DataFrame, user: str, key: str) -> DataFrame:
    """documents with ``is_active``: the last one of each user."""
    last = documents.groupBy(user).agg(F.max(key).alias("_last"))
    return documents.join(last, user).withColumn("is_active", F.col(key) == F.col("_last")).drop("_last")


def replace_drafts(drafts: DataFrame, new: DataFrame) -> DataFrame:
    """All drafts of the jobs in ``new`` replaced by the new ones."""
    return drafts.join(new.select("job_id"), "job_id", "left_anti").unionByName(new)
