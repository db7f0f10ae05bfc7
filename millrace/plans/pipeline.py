"""The batch pipeline: validate, normalise, filter, cluster, check against history, enrich."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fields, salary, text
from millrace.operators import dedup, filters, store, validation

RAW_REQUIRED = ("id", "title", "company", "source", "url", "description", "posted_date")


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) raw postings."""
    ok = validation.raw_posting(F.col("source"), F.col("url"), F.col("description"), *[F.col(c) for c in RAW_REQUIRED])
    return raw.where(ok), raw.where(~ok)


def normalise(raw: DataFrame, as_of: Column) -> DataFrame:
    """Raw postings as stored postings; malformed titles leave first."""
    sound = raw.where(~F.coalesce(fields.malformed_title(F.col("title")), F.lit(False)))
    staged = sound.withColumns(
        {
            "_place": fields.standardize_location(F.col("location")),
            "_pay": salary.extract(F.col("salary_raw"), F.col("description"), F.col("salary_min_raw"), F.col("salary_max_raw"), F.col("salary_currency"), F.col("salary_interval")),
        }
    )
    return staged.select(
        F.col("id").alias("raw_id"), fields.job_id(F.col("source"), F.col("url")).alias("job_id"), "user_id", "source", fields.extract_job_id(F.col("url")).alias("source_job_id"), "url",
        fields.url_hostname(F.col("url")).alias("url_hostname"), "title", text.normalize_text(F.col("title")).alias("title_normalized"), "company", text.normalize_text(F.col("company")).alias("company_normalized"),
        F.col("_place").alias("location"), fields.is_remote(F.col("_place")).alias("is_remote"), fields.parse_posted_date(F.col("posted_date"), as_of).alias("posted_at"), "description",
        F.bround("_pay.low").cast("int").alias("salary_min_cad"), F.bround("_pay.high").cast("int").alias("salary_max_cad"), F.col("_pay.source").alias("salary_source"),
        fields.infer_seniority(F.col("title")).alias("seniority"), F.lit(None).cast("string").alias("company_employees_label"), "scraped_at", "expected_specialty",
    )


def enrich(postings: DataFrame) -> DataFrame:
    """Pay that is still unknown read from the description, column by column, cut to whole dollars."""
    staged = postings.withColumn("_pay", F.when(F.col("salary_min_cad").isNull() | F.col("salary_max_cad").isNull() | F.col("salary_source").isNull(), salary.from_text(F.col("description"))))
    return staged.withColumns({"salary_min_cad": F.coalesce("salary_min_cad", F.col("_pay.low").cast("int")), "salary_max_cad": F.coalesce("salary_max_cad", F.col("_pay.high").cast("int")), "salary_source": F.coalesce("salary_source", "_pay.source")}).drop("_pay")


@dataclass
class Run:
    """The tables of a run, stage by stage."""

    accepted: DataFrame
    rejected: DataFrame
    normalised: DataFrame
    flagged: DataFrame
    titled: DataFrame


def staged(raw: DataFrame, config: filters.FilterConfig, as_of: Column) -> Run:
    """The stages up to the title filter; nothing runs yet."""
    accepted, rejected = split_valid(raw)
    normalised = normalise(accepted, as_of)
    flagged = filters.apply_filters(normalised, config)
    titled = flagged.where("excluded_reason IS NULL").withColumn("title_rule", filters.title_rule(F.col("title")))
    return Run(accepted, rejected, normalised, flagged, titled)


def cluster(titled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first rows of the clusters, all rows with cluster and kept) of postings that passed both filters."""
    # one row a job: pages scraped twice are the same posting
    rows = store.first_rows(titled.where("title_rule != 'denylist'"), ["job_id"], ["scraped_at", "raw_id"]).withColumn("fp", text.fingerprint(F.col("title"), F.col("company"))).withColumn("seq", F.concat_ws("|", F.date_format("scraped_at", "yyyyMMddHHmmss"), F.col("job_id")))
    clustered = dedup.cross_source_clusters(rows, "seq", "job_id")
    return clustered.where("kept").drop("cluster", "kept"), clustered


def check_history(kept: DataFrame, existing: DataFrame) -> DataFrame:
    """Decisions on clustered rows against stored jobs, in order."""
    words = lambda: F.concat_ws(" ", "title_normalized", "company_normalized")
    # times are whole seconds: what is below settles the order of equal ones
    below = F.pmod(F.xxhash64("job_id"), F.lit(1_000_000))
    batch = kept.select(F.col("job_id").alias("new_id"), (F.unix_micros("scraped_at") + below).alias("seq"), "url", words().alias("text"), "description")
    old = existing.select(F.col("job_id").alias("old_id"), (below - F.unix_micros("fetched_at")).alias("rank"), "url", words().alias("text"), "description")
    return dedup.resolve_in_order(batch, old)
