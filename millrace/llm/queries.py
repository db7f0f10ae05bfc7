"""The queries of the llm operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import incremental, leakage, near_duplicates, packing, reference_match, survivors, text_quality
from millrace.session import table

DAY_MS = 86_400_000


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_match.canonical_values(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "ref_locations"), table(spark, sf_dir, "ref_size_labels"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every open location and size label with the entry meant, -1 for none."""
    return _canonical(spark, sf_dir).select("job_id", "field_name", "ref_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that fit no entry, with the number of rows that hold them."""
    return _canonical(spark, sf_dir).where(F.col("ref_id") == reference_match.UNMATCHED).groupBy("field_name", "value").agg(F.count("*").alias("n_rows"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members whose pay and size bucket survive: the latest value of the most trusted source outvotes all others."""
    won = survivors.survivors(table(spark, sf_dir, "jobs"), half_life_ms=survivors.LATEST, source_trust=survivors.ANY_AGE)
    return won.select(F.col("group_key").alias("group_job_id"), F.col("salary_min_cad_key").alias("salary_job_id"), F.col("company_size_bucket_key").alias("bucket_job_id"))


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record with votes that halve in 90 days, the site's own pay counting four times as much."""
    won = survivors.survivors(table(spark, sf_dir, "jobs"), half_life_ms=90 * DAY_MS, source_trust=2)
    return won.select(F.col("group_key").alias("group_job_id"), F.col("salary_min_cad").cast("int").alias("salary_min_cad"), "company_size_bucket")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of jobs rows that share three quarters of their words."""
    return near_duplicates.similar_pairs(table(spark, sf_dir, "jobs"), "job_id", ["title", "description"])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that near-duplicate jobs rows form."""
    return near_duplicates.similar_groups(table(spark, sf_dir, "jobs"), "job_id", ["title", "description"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incoming row that repeats an accepted posting, with that posting."""
    return incremental.check_batches(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "incoming_jobs"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a container of each capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers of each capacity are used, and how full they are."""
    sizes = table(spark, sf_dir, "pack_sizes")
    return packing.fill(packing.pack(table(spark, sf_dir, "documents"), sizes), sizes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and an item of whose passage it holds twelve consecutive words."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the documents that hold it, the longest share and whether question and answer leaked along."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.count("*").alias("n_docs"), F.max("shared_words").alias("most_shared_words"), F.sum((F.col("question_share") == 1).cast("int")).alias("n_with_question"), F.sum(F.col("answer_found").cast("int")).alias("n_with_answer")
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of which less than half of the characters belong to full sentences."""
    return text_quality.not_prose(table(spark, sf_dir, "documents"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text statistics and its kind."""
    return text_quality.classify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_survivors, p4_found, p4_groups, p6_found, p7_packed, p7_fill, p8_found, p8_leaked_items, p9_found, p9_statistics)}
