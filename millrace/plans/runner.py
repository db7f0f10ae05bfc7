"""A whole run: stages, logs, and the tables it leaves behind."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import dedup, filters, store
from millrace.plans import pipeline
from millrace.session import cut


@dataclass
class RunResult:
    """Counts of the stages and the new state of the tables."""

    counts: dict[str, int]
    jobs: DataFrame
    duplicates: DataFrame
    classifications: DataFrame
    errors: list[str] = field(default_factory=list)

    def summary(self) -> str:
        """The audit row's JSON."""
        return json.dumps({"replay": {"status": "ok", "count": self.counts["fetched"]}})


def run_folder(root: str, now: datetime | None = None) -> str:
    """A folder of its own for each run."""
    return f"{root}/run_{(now or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S_%f')}"


def write_stage_log(rows: DataFrame, folder: str | None, stage: str, errors: list[str]) -> None:
    """One stage as JSON lines; an existing log is never written over, and a failure only notes itself."""
    if folder is None:
        return
    try:
        rows.write.mode("errorifexists").json(f"{folder}/{stage}")
    except Exception as e:  # noqa: BLE001
        errors.append(f"{stage}: {e}")


def replay(raw: DataFrame, jobs: DataFrame, duplicates: DataFrame, classifications: DataFrame, as_of: str, config: filters.FilterConfig | None = None, window_days: int = 90, seen_at: Column | None = None, log_folder: str | None = None, status: Callable[[str], None] | None = None) -> RunResult:
    """Run a captured batch against the stored tables.

    Stages: contract, normalise, hard filter, title filter, clusters of the
    batch, check in order against the window of stored jobs, enrich, store.
    """
    say = status or (lambda _: None)
    errors: list[str] = []
    config = config or filters.FilterConfig()
    run = pipeline.staged(raw, config, seen_at if seen_at is not None else F.lit(as_of).cast("timestamp"))
    say("normalise and filter")
    flagged = cut(run.flagged.withColumn("title_rule", filters.title_rule(F.col("title"))))
    write_stage_log(flagged.select("raw_id", "job_id", "excluded_reason", "title_rule"), log_folder, "03_filters", errors)
    titled = flagged.where("excluded_reason IS NULL")
    say("cluster")
    kept, clustered = pipeline.cluster(titled)
    clustered = cut(clustered)
    kept = clustered.where("kept").drop("cluster", "kept")
    write_stage_log(clustered.select("job_id", "cluster", "kept"), log_folder, "05_clusters", errors)
    say("check against history")
    decided = cut(pipeline.check_history(kept, dedup.dedup_window(jobs, as_of, window_days)))
    write_stage_log(decided, log_folder, "06_decisions", errors)
    say("store")
    resolved = pipeline.enrich(kept).join(decided.withColumnRenamed("new_id", "job_id"), "job_id")
    stored_kinds = F.col("decision") != "within_run_dup"
    shape = {c: F.col(c) if c in kept.columns else F.lit(None).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns}
    shape |= {"duplicate_of": F.col("canonical_id").alias("duplicate_of"), "fetched_at": F.lit(as_of).cast("timestamp").alias("fetched_at"), "state": F.lit("new").alias("state"), "state_updated_at": F.lit(as_of).cast("timestamp").alias("state_updated_at")}
    rows = resolved.where(stored_kinds).select(*[shape[c] for c in jobs.columns])
    fresh = cut(store.insert_or_ignore(jobs, rows, ["job_id"], ["job_id"]).select(*jobs.columns))
    found = cut(decided.where("canonical_id IS NOT NULL").select(F.col("new_id").alias("duplicate_post_id"), F.col("canonical_id").alias("canonical_post_id"), F.col("decision").alias("match_type"), "match_score", F.lit(as_of).cast("timestamp").alias("detected_at")))
    top = duplicates.agg(F.coalesce(F.max("duplicate_id"), F.lit(0)).alias("m")).first().m
    new_duplicates = store.next_ids(found, top, ["duplicate_post_id"], "duplicate_id").select(*duplicates.columns)
    stubs = fresh.where("duplicate_of IS NULL").select("job_id", "user_id", F.lit("Unclassified").alias("specialty_name"), F.lit("low").alias("confidence"), F.lit("[]").alias("duty_signals"), F.lit("stub").alias("model_name"), F.lit("stub-v0").alias("prompt_version"), F.lit(as_of).cast("timestamp").alias("classified_at"))
    top = classifications.agg(F.coalesce(F.max("classification_id"), F.lit(0)).alias("m")).first().m
    new_classes = store.next_ids(stubs.join(classifications.select("job_id"), "job_id", "left_anti"), top, ["job_id"], "classification_id").select(*classifications.columns)
    passed = F.col("excluded_reason").isNull()
    counted = flagged.agg(F.count("*").alias("normalised"), F.count_if(passed).alias("passed_filters"), F.count_if(passed & (F.col("title_rule") != "denylist")).alias("passed_titles")).first()
    kinds = {r.decision: r["count"] for r in decided.groupBy("decision").count().collect()}
    counts = {
        "fetched": raw.count(), "normalised": counted.normalised, "passed_filters": counted.passed_filters, "passed_titles": counted.passed_titles, "distinct_jobs": clustered.count(), "clusters": kept.count(),
        "canonical": kinds.get("canonical", 0), "duplicates": sum(kinds.get(k, 0) for k in ("fuzzy_title_company", "description_similarity")), "within_run": kinds.get("within_run_dup", 0), "stored": fresh.count(),
    }
    return RunResult(counts, jobs.unionByName(fresh), duplicates.unionByName(new_duplicates), classifications.unionByName(new_classes), errors)


def set_enabled(specialties: DataFrame, name: str, enabled: bool) -> DataFrame:
    """specialties with one switched on or off."""
    return specialties.withColumn("enabled", F.when(F.col("name") == name, F.lit(enabled)).otherwise(F.col("enabled")))


def head_is_fine(url: str) -> bool:
    """Whether a url answers with a status below 400 within five seconds."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=5) as answer:  # noqa: S310
            return answer.status < 400
    except Exception:  # noqa: BLE001
        return False


def url_health(urls: DataFrame, probe: Callable[[str], bool | None] | None = None) -> DataFrame:
    """(url, url_is_dead) of distinct urls; without a probe nothing is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            alive = [None if probe is None else probe(u) for u in pdf["url"]]
            yield pdf.assign(url_is_dead=pd.array([None if a is None else not a for a in alive], dtype="boolean"))

    return urls.where("url IS NOT NULL").select("url").dropDuplicates().mapInPandas(run, "url string, url_is_dead boolean")


def swap_table(rows: DataFrame, folder: str, name: str) -> str:
    """Write a new version of a table beside the old one and point to it; readers of the old version are not disturbed."""
    path = f"{folder}/{name}/{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(path)
    return path
