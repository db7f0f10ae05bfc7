"""Queries of the store, joins, resolution, aggregates, ranked lists and events over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text
from millrace.operators import dedup, feed, filters, signals, store
from millrace.plans import pipeline, resolution_sql, runner
from millrace.plans.registry import Book
from millrace.plans.scalar_queries import TITLE_SQL, VALID_SQL, jobs, malformed_sql, raw
from millrace.session import cut, table

BOOK = Book()
USER = "local"
AS_OF = "2026-05-01 00:00:00"
# The specialties of a new store, with their tier and whether they are in use.
SPECIALTIES = [("data_scientist", 1, True), ("ml_engineer", 1, True), ("data_engineer", 1, True), ("data_analyst", 1, True), ("analytics_engineer", 2, False)]


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """incoming_jobs."""
    return table(spark, d, "incoming_jobs")


def classes(spark: SparkSession, d: str) -> DataFrame:
    """classifications."""
    return table(spark, d, "classifications")


def events(spark: SparkSession, d: str) -> DataFrame:
    """signal_events."""
    return table(spark, d, "signal_events")


# --- store --------------------------------------------------------------------------------------------


@BOOK.add("SELECT job_id, min(arrival_id) AS arrival_id FROM incoming_jobs WHERE job_id NOT IN (SELECT job_id FROM jobs) GROUP BY job_id")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows that enter the store: the first of each id that isn't there."""
    return store.insert_or_ignore(jobs(spark, d), incoming(spark, d).select("job_id", "arrival_id"), ["job_id"], ["arrival_id"])


@BOOK.add("SELECT j.job_id, coalesce(u.c, j.duplicate_of) AS duplicate_of FROM jobs j LEFT JOIN (SELECT duplicate_post_id, arg_max(canonical_post_id, duplicate_id) AS c FROM duplicates GROUP BY 1) u ON u.duplicate_post_id = j.job_id")
def apply_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after the audit rows of duplicates."""
    return store.apply_duplicates(jobs(spark, d).select("job_id", "duplicate_of"), table(spark, d, "duplicates"))


MOVED_SQL = "event_type IN ('state_change', 'mark_applied', 'mark_dismissed', 'un_apply', 'un_dismiss') AND job_id IS NOT NULL AND to_state IS NOT NULL"
LAST_SQL = f"(SELECT job_id, arg_max(to_state, (epoch_us(recorded_at), event_id)) AS s, max(epoch_us(recorded_at)) AS t FROM signal_events WHERE {MOVED_SQL} GROUP BY job_id)"


@BOOK.add(f"SELECT j.job_id, coalesce(e.s, j.state) AS state, coalesce(e.t, epoch_us(j.state_updated_at)) AS updated_us FROM jobs j LEFT JOIN {LAST_SQL} e USING (job_id)")
def update_state(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after all recorded moves."""
    last = signals.moves(events(spark, d)).groupBy("job_id").agg(F.max_by("to_state", F.struct("recorded_at", "event_id")).alias("s"), F.max("recorded_at").alias("t"))
    return jobs(spark, d).select("job_id", "state", "state_updated_at").join(last, "job_id", "left").select("job_id", F.coalesce("s", "state").alias("state"), F.unix_micros(F.coalesce("t", "state_updated_at")).alias("updated_us"))


@BOOK.add(f"""WITH gone AS (SELECT job_id FROM jobs WHERE user_id = '{USER}')
SELECT 'jobs' AS table_name, count(*) AS n FROM jobs WHERE user_id IS DISTINCT FROM '{USER}'
UNION ALL SELECT 'classifications', count(*) FROM classifications WHERE user_id IS DISTINCT FROM '{USER}'
UNION ALL SELECT 'duplicates', count(*) FROM duplicates WHERE duplicate_post_id NOT IN (FROM gone) AND canonical_post_id NOT IN (FROM gone)
UNION ALL SELECT 'signal_events', count(*) FROM signal_events WHERE NOT coalesce(user_id = '{USER}' AND job_id IN (FROM gone), false)""")
def cascade_delete_survivors(spark: SparkSession, d: str) -> DataFrame:
    """What is left after a user's jobs are deleted."""
    tables = {n: table(spark, d, n) for n in ("jobs", "classifications", "duplicates", "signal_events")}
    left = store.delete_user(tables, USER)
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, t in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stubs(spark: SparkSession, d: str) -> DataFrame:
    """The rows the stub classifier writes for canonical jobs."""
    return jobs(spark, d).where("duplicate_of IS NULL").select("job_id", "user_id", F.lit("Unclassified").alias("specialty_name"), F.lit("low").alias("confidence"), F.lit("[]").alias("duty_signals"), F.lit("stub").alias("model_name"), F.lit("stub-v0").alias("prompt_version"), F.col("fetched_at").alias("classified_at"))


@BOOK.add("SELECT job_id, user_id FROM jobs WHERE duplicate_of IS NULL AND job_id NOT IN (SELECT job_id FROM classifications)")
def classification_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Stub rows for jobs without a classification."""
    return store.insert_or_ignore(classes(spark, d), stubs(spark, d), ["job_id"], ["classified_at"]).select("job_id", "user_id")


@BOOK.add("""SELECT coalesce(c.job_id, j.job_id) AS job_id, coalesce(c.classification_id, (SELECT max(classification_id) FROM classifications) + j.k) AS classification_id, coalesce(c.user_id, j.user_id) AS user_id,
CASE WHEN j.job_id IS NOT NULL THEN 'Unclassified' ELSE c.specialty_name END AS specialty_name, CASE WHEN j.job_id IS NOT NULL THEN 'stub-v0' ELSE c.prompt_version END AS prompt_version
FROM classifications c FULL OUTER JOIN (SELECT job_id, user_id, row_number() OVER (PARTITION BY job_id IN (SELECT job_id FROM classifications) ORDER BY job_id) AS k FROM jobs WHERE duplicate_of IS NULL) j ON c.job_id = j.job_id""")
def upsert_classification(spark: SparkSession, d: str) -> DataFrame:
    """Classifications after the stub classifier wrote over them: id and user of old rows stay, new rows get the next ids."""
    old, new = classes(spark, d), stubs(spark, d)
    top = old.agg(F.coalesce(F.max("classification_id"), F.lit(0)).alias("m")).first().m
    fresh = store.next_ids(new.join(old.select("job_id"), "job_id", "left_anti"), top, ["job_id"], "classification_id").select("job_id", "classification_id")
    numbered = new.join(fresh, "job_id", "left")
    merged = store.upsert(old, numbered, "job_id", ["specialty_name", "confidence", "duty_signals", "model_name", "prompt_version", "classified_at"])
    return merged.select("job_id", "classification_id", "user_id", "specialty_name", "prompt_version")


@BOOK.add("SELECT doc_id, doc_id = max(doc_id) OVER (PARTITION BY source) AS is_active FROM documents")
def kb_single_active(spark: SparkSession, d: str) -> DataFrame:
    """The one active document of each user (here: feed)."""
    return store.single_active(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "is_active")


@BOOK.add("""SELECT source, count(*) AS n_docs, sum(len(string_split(text, chr(10) || chr(10)))) AS n_chunks FROM documents WHERE doc_id NOT IN (SELECT max(doc_id) FROM documents GROUP BY source) GROUP BY source""")
def kb_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents and chunks left after each user's active document is deleted."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    gone = docs.groupBy("source").agg(F.max("doc_id").alias("doc_id")).select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.size(F.split("text", "\n\n"))).alias("n_chunks"))


@BOOK.add("SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM jobs WHERE state = 'applied') THEN 'applied' ELSE model_name END AS reason FROM classifications UNION SELECT job_id, 'applied' FROM jobs WHERE state = 'applied'")
def draft_replace(spark: SparkSession, d: str) -> DataFrame:
    """Drafts after those of applied jobs were written anew."""
    old = classes(spark, d).select("job_id", F.col("model_name").alias("reason"))
    return store.replace_drafts(old, jobs(spark, d).where("state = 'applied'").select("job_id", F.lit("applied").alias("reason")))


@BOOK.add("""SELECT u.user_id, 'both' AS location_preference, coalesce(n.floor, 120000)::BIGINT AS salary_floor_cad, n.user_id IS NOT NULL AS changed FROM (SELECT DISTINCT user_id FROM scrape_runs UNION SELECT DISTINCT user_id FROM jobs WHERE salary_min_cad IS NOT NULL) u
LEFT JOIN (SELECT user_id, min(salary_min_cad) AS floor FROM jobs WHERE salary_min_cad IS NOT NULL GROUP BY user_id) n USING (user_id)""")
def upsert_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings after each user asked for a floor."""
    old = table(spark, d, "scrape_runs").select("user_id").dropDuplicates().select("user_id", F.lit("both").alias("location_preference"), F.lit(120000).cast("long").alias("salary_floor_cad"), F.lit(False).alias("changed"))
    new = jobs(spark, d).where("salary_min_cad IS NOT NULL").groupBy("user_id").agg(F.min("salary_min_cad").cast("long").alias("salary_floor_cad")).select("user_id", F.lit("both").alias("location_preference"), "salary_floor_cad", F.lit(True).alias("changed"))
    return store.upsert(old, new, "user_id", ["location_preference", "salary_floor_cad", "changed"])


@BOOK.add("SELECT user_id, specialty_name AS name, min(classification_id) AS first_id FROM classifications WHERE specialty_name NOT IN ('Data Scientist', 'ML Engineer') OR user_id <> 'local' GROUP BY user_id, specialty_name")
def specialty_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Specialties that enter beside two seeded ones of the local user."""
    old = spark.createDataFrame([(USER, "Data Scientist"), (USER, "ML Engineer")], "user_id string, name string")
    new = classes(spark, d).select("user_id", F.col("specialty_name").alias("name"), F.col("classification_id").alias("first_id"))
    return store.insert_or_ignore(old, new, ["user_id", "name"], ["first_id"])


@BOOK.add("""SELECT run_id, finished_at IS NOT NULL AS finished, coalesce(total_fetched, list_sum(list_transform(json_extract_string(source_results_json, '$.*.count'), lambda c: c::BIGINT)))::BIGINT AS total_fetched, error_log FROM scrape_runs""")
def run_audit(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows; open runs count what their sources said so far."""
    said = F.from_json("source_results_json", "map<string, struct<status string, count bigint>>")
    total = F.aggregate(F.map_values(said), F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["count"], F.lit(0).cast("long")))
    return table(spark, d, "scrape_runs").select("run_id", F.col("finished_at").isNotNull().alias("finished"), F.coalesce(F.col("total_fetched").cast("long"), total).alias("total_fetched"), "error_log")


@BOOK.add("SELECT name, tier::INTEGER AS tier, enabled, CASE WHEN tier = 1 THEN 'seed' ELSE 'config' END AS source FROM (VALUES ('data_scientist', 1, true), ('ml_engineer', 1, true), ('data_engineer', 1, true), ('data_analyst', 1, true), ('analytics_engineer', 2, false)) AS t(name, tier, enabled)")
def seed_specialties(spark: SparkSession, d: str) -> DataFrame:
    """The specialties of a new store."""
    rows = spark.createDataFrame(SPECIALTIES, "name string, tier int, enabled boolean")
    return rows.withColumn("source", F.when(F.col("tier") == 1, "seed").otherwise("config"))


# --- joins --------------------------------------------------------------------------------------------


@BOOK.add("SELECT job_id FROM jobs JOIN classifications c USING (job_id) WHERE jobs.user_id = 'local' AND c.specialty_name = 'Data Scientist' AND state <> 'dismissed' ORDER BY posted_at DESC NULLS LAST, salary_min_cad DESC NULLS LAST, job_id LIMIT 200")
def list_jobs_by_specialty(spark: SparkSession, d: str) -> DataFrame:
    """The feed of one specialty."""
    chosen = classes(spark, d).where("specialty_name = 'Data Scientist'").select("job_id")
    return feed.list_jobs(jobs(spark, d).join(chosen, "job_id", "left_semi"), USER).select("job_id")


@BOOK.add("SELECT j.job_id, coalesce(c.specialty_name, 'Unclassified') AS specialty FROM jobs j LEFT JOIN classifications c USING (job_id)")
def feed_with_specialty(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with their specialty."""
    return feed.with_specialty(jobs(spark, d).select("job_id"), classes(spark, d)).select("job_id", "specialty")


@BOOK.add("SELECT j.job_id, coalesce(o.title || ' at ' || o.company_normalized, substr(j.duplicate_of, 1, 12)) AS canonical_label FROM jobs j LEFT JOIN jobs o ON o.job_id = j.duplicate_of WHERE j.duplicate_of IS NOT NULL")
def canonical_label(spark: SparkSession, d: str) -> DataFrame:
    """What duplicates repeat."""
    return feed.canonical_label(jobs(spark, d))


@BOOK.add("SELECT d.duplicate_id, d.match_type, d.match_score, j.title FROM duplicates d JOIN jobs j ON j.job_id = d.duplicate_post_id")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows with titles."""
    dup = table(spark, d, "duplicates")
    return dup.join(jobs(spark, d).select(F.col("job_id").alias("duplicate_post_id"), "title"), "duplicate_post_id").select("duplicate_id", "match_type", "match_score", "title")


@BOOK.add("SELECT i.arrival_id, min(j.job_id) AS job_id FROM incoming_jobs i JOIN jobs j ON i.url = j.url GROUP BY i.arrival_id")
def url_exact_dup(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows whose url is stored letter for letter."""
    known = jobs(spark, d).groupBy("url").agg(F.min("job_id").alias("job_id"))
    return incoming(spark, d).select("arrival_id", "url").join(known, "url").select("arrival_id", "job_id")


# --- resolution ---------------------------------------------------------------------------------------


def _texts(rows: DataFrame, key: str, order) -> DataFrame:
    return rows.select(F.col(key), order.alias("place"), "url", F.concat_ws(" ", "title_normalized", "company_normalized").alias("text"), "description")


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return _texts(incoming(spark, d).withColumn("new_id", F.col("arrival_id").cast("string")), "new_id", F.col("arrival_id")).withColumnRenamed("place", "seq")


def _existing(spark: SparkSession, d: str) -> DataFrame:
    """Stored canonical jobs, the latest fetched first, those of one time by job_id."""
    canonical = jobs(spark, d).where("duplicate_of IS NULL").withColumn("old_id", F.col("job_id"))
    return _texts(canonical, "old_id", F.coalesce(-F.unix_micros("fetched_at"), F.lit(2**63 - 1))).withColumnRenamed("place", "rank")


@BOOK.add(resolution_sql.FUZZY_PAIRS)
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of fingerprints of a captured batch with a ratio of at least 85."""
    rows = raw(spark, d).select(text.fingerprint(F.col("title"), F.col("company")).alias("s"))
    return dedup.fuzzy_join(rows, None, dedup.CLUSTER_AT)


@BOOK.add(resolution_sql.BEST_MATCH)
def best_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """The best stored match of each incoming row."""
    return dedup.best_matches(_batch(spark, d), _existing(spark, d))


@BOOK.add(resolution_sql.CHECK)
def dedup_check(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows that repeat a stored one, each on its own."""
    return dedup.dedup_check(_batch(spark, d), _existing(spark, d))


@BOOK.add(resolution_sql.CLUSTERS)
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of a captured batch by fingerprint; the first of each is kept."""
    rows = cut(raw(spark, d).select("id", "scraped_at", text.fingerprint(F.col("title"), F.col("company")).alias("fp")).dropDuplicates())
    return dedup.cross_source_clusters(rows, "scraped_at", "id").select("id", "cluster", "kept")


@BOOK.add(resolution_sql.CROSS_RUN)
def cross_run_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows checked in order against stored ones and against what was accepted before."""
    return dedup.resolve_in_order(_batch(spark, d), _existing(spark, d))


@BOOK.add(resolution_sql.SEED)
def seed_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A first batch checked in order against itself alone."""
    return dedup.resolve_in_order(_batch(spark, d), _existing(spark, d).limit(0))


@BOOK.add(f"SELECT job_id FROM jobs WHERE duplicate_of IS NULL AND fetched_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 90 DAY")
def dedup_window(spark: SparkSession, d: str) -> DataFrame:
    """What a batch is checked against."""
    return dedup.dedup_window(jobs(spark, d), AS_OF, 90).select("job_id")


# --- aggregates ---------------------------------------------------------------------------------------


FUNNEL_CONFIG = filters.FilterConfig()


@BOOK.add(
    f"""WITH ok AS (SELECT * FROM raw_postings WHERE {VALID_SQL}), sound AS (SELECT * FROM ok WHERE NOT {malformed_sql('title')})
SELECT 'fetched' AS stage, count(*) AS n FROM raw_postings UNION ALL SELECT 'rejected', count(*) FROM raw_postings WHERE NOT {VALID_SQL} UNION ALL SELECT 'malformed', (SELECT count(*) FROM ok) - (SELECT count(*) FROM sound)
UNION ALL SELECT 'normalised', count(*) FROM sound UNION ALL SELECT 'title_dropped', count(*) FROM sound WHERE {TITLE_SQL} = 'denylist' UNION ALL SELECT 'distinct_jobs', count(DISTINCT source || ':' || url) FROM sound"""
)
def pipeline_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many postings pass each stage of a replayed batch, in one pass."""
    rows = raw(spark, d)
    run = pipeline.staged(rows, FUNNEL_CONFIG, F.col("scraped_at"))
    ok = pipeline.validation.raw_posting(F.col("source"), F.col("url"), F.col("description"), *[F.col(c) for c in pipeline.RAW_REQUIRED])
    bad = ok & pipeline.fields.malformed_title(F.col("title"))
    counts = rows.agg(F.count("*").alias("fetched"), F.count_if(~ok).alias("rejected"), F.count_if(bad).alias("malformed"))
    passed = run.normalised.agg(F.count("*").alias("normalised"), F.count_if(filters.title_rule(F.col("title")) == "denylist").alias("title_dropped"), F.countDistinct("job_id").alias("distinct_jobs"))
    stages = lambda t: t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in t.columns])).alias("x")).select("x.*")
    return stages(counts).unionByName(stages(passed))


@BOOK.add()
def replay_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A captured batch run against the store, stage by stage: how many postings are left after each."""
    done = runner.replay(raw(spark, d), jobs(spark, d), table(spark, d, "duplicates"), classes(spark, d), AS_OF, seen_at=F.col("scraped_at"))
    return spark.createDataFrame(list(done.counts.items()), "stage string, n long")


@BOOK.add("SELECT source, count(*) AS n FROM raw_postings GROUP BY source")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    """Postings of each source."""
    return raw(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@BOOK.add("SELECT count(*) FILTER (WHERE state = 'applied') AS applied, count(*) FILTER (WHERE state = 'dismissed') AS dismissed, count(*) AS total FROM jobs")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    """Applied and dismissed jobs."""
    return jobs(spark, d).agg(F.count_if(F.col("state") == "applied").alias("applied"), F.count_if(F.col("state") == "dismissed").alias("dismissed"), F.count("*").alias("total"))


@BOOK.add("SELECT seniority, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM jobs), 4) AS pct FROM jobs GROUP BY seniority")
def seniority_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of each level."""
    levels = jobs(spark, d).groupBy("seniority").agg(F.count("*").alias("n"))
    return levels.select("seniority", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4).alias("pct"))  # a row a level


COVERED = ("location", "posted_at", "salary_min_cad", "salary_max_cad", "company_employees_label", "is_remote")


@BOOK.add(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n_known, count(*) AS n FROM jobs" for c in COVERED))
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often each field is known."""
    one = jobs(spark, d).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in COVERED])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_known")) for c in COVERED])).alias("x")).select("x.field", "x.n_known", "n")


@BOOK.add(f"""SELECT strftime(date_trunc('week', m), '%Y-%m-%d') AS week, count(*) AS n_final, sum(hit)::BIGINT AS n_override, round(avg(hit), 6) AS override_rate
FROM (SELECT user_id, job_id, to_state, date_trunc('minute', to_timestamp(epoch_us(recorded_at) // 1000000) AT TIME ZONE 'UTC') AS m, max(CASE WHEN coalesce(specialty_name, 'Unclassified') = 'Unclassified' THEN 1 ELSE 0 END) AS hit
FROM signal_events WHERE {MOVED_SQL} AND to_state IN ('applied', 'dismissed') GROUP BY 1, 2, 3, 4) GROUP BY 1""")
def override_rate_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Extension: overrides per week."""
    return signals.override_rate_weekly(events(spark, d))


# --- ranked lists -------------------------------------------------------------------------------------

ORDER_SQL = "ORDER BY posted_at DESC NULLS LAST, salary_min_cad DESC NULLS LAST, job_id"


@BOOK.add(f"SELECT job_id, title, state FROM jobs WHERE user_id = 'local' AND state <> 'dismissed' {ORDER_SQL} LIMIT 200")
def list_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the feed."""
    return feed.list_jobs(jobs(spark, d), USER).select("job_id", "title", "state")


@BOOK.add(f"SELECT job_id, title FROM jobs WHERE user_id = 'local' AND state = 'applied' {ORDER_SQL} LIMIT 200")
def list_jobs_state(spark: SparkSession, d: str) -> DataFrame:
    """Applied jobs."""
    return feed.list_jobs(jobs(spark, d), USER, "applied").select("job_id", "title")


@BOOK.add(f"SELECT job_id FROM jobs WHERE user_id = 'local' AND state <> 'dismissed' {ORDER_SQL} LIMIT 20 OFFSET 20")
def list_jobs_page(spark: SparkSession, d: str) -> DataFrame:
    """A later page."""
    return feed.list_jobs(jobs(spark, d), USER, limit=20, offset=20).select("job_id")


@BOOK.add(f"""SELECT p.job_id, coalesce(c.specialty_name, 'Unclassified') AS specialty, p.state FROM (SELECT * FROM jobs WHERE user_id = 'local' AND state <> 'dismissed' {ORDER_SQL} LIMIT 200) p LEFT JOIN classifications c USING (job_id) WHERE p.state NOT IN ('applied', 'dismissed')""")
def feed_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The feed in its second order."""
    return feed.feed_sorted(jobs(spark, d), classes(spark, d), USER).select("job_id", "specialty", "state")


@BOOK.add("SELECT job_id, arg_max(event_id, (epoch_us(recorded_at), event_id)) AS event_id FROM signal_events WHERE event_type = 'mark_applied' AND job_id IS NOT NULL GROUP BY job_id")
def latest_draft(spark: SparkSession, d: str) -> DataFrame:
    """The latest draft of each job; applying writes one."""
    return events(spark, d).where("event_type = 'mark_applied' AND job_id IS NOT NULL").groupBy("job_id").agg(F.max_by("event_id", F.struct("recorded_at", "event_id")).alias("event_id"))


@BOOK.add("SELECT event_id, event_type, epoch_us(recorded_at) AS recorded_us FROM signal_events WHERE user_id = 'local'")
def list_signals(spark: SparkSession, d: str) -> DataFrame:
    """A user's events."""
    return feed.list_signals(events(spark, d), USER).select("event_id", "event_type", F.unix_micros("recorded_at").alias("recorded_us"))


@BOOK.add(f"SELECT event_id, event_type FROM signal_events WHERE user_id = 'local' AND recorded_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 60 DAY")
def list_signals_window(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of the last days."""
    return feed.list_signals(events(spark, d), USER, as_of=AS_OF, window_days=60).select("event_id", "event_type")


@BOOK.add("SELECT name, tier::INTEGER AS tier FROM (VALUES ('data_scientist', 1), ('ml_engineer', 1), ('data_engineer', 1), ('data_analyst', 1)) AS t(name, tier) ORDER BY tier, name")
def list_specialties(spark: SparkSession, d: str) -> DataFrame:
    """Specialties in use."""
    return seed_specialties(spark, d).where("enabled").orderBy("tier", "name").select("name", "tier")


@BOOK.add("SELECT canonical_post_id, duplicate_id, duplicate_post_id FROM duplicates")
def list_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows, the latest first."""
    return table(spark, d, "duplicates").orderBy(F.desc("detected_at"), F.desc("duplicate_id")).select("canonical_post_id", "duplicate_id", "duplicate_post_id")


@BOOK.add("SELECT doc_id, source, epoch_us(collected_at) AS collected_us FROM documents")
def list_kb_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents, the latest first."""
    return table(spark, d, "documents").orderBy(F.desc("collected_at"), F.desc("doc_id")).select("doc_id", "source", F.unix_micros("collected_at").alias("collected_us"))


@BOOK.add("SELECT job_id, title, company, state FROM jobs WHERE job_id = (SELECT min(job_id) FROM jobs)")
def get_job(spark: SparkSession, d: str) -> DataFrame:
    """One job by its key."""
    j = jobs(spark, d)
    key = j.agg(F.min("job_id").alias("k")).first().k
    return j.where(F.col("job_id") == key).select("job_id", "title", "company", "state")


# --- events -------------------------------------------------------------------------------------------


@BOOK.add(f"SELECT event_id, CASE WHEN to_state IN ('applied', 'dismissed') AND coalesce(specialty_name, 'Unclassified') = 'Unclassified' THEN 'acted_on_unclassified' END AS override_reason FROM signal_events WHERE {MOVED_SQL}")
def override_reason(spark: SparkSession, d: str) -> DataFrame:
    """Overrides inferred from moves."""
    return signals.moves(events(spark, d)).select("event_id", signals.override_reason(F.col("to_state"), F.col("specialty_name")).alias("override_reason"))


@BOOK.add("""SELECT job_id, step::INTEGER AS step, event_type, from_state, to_state FROM (SELECT job_id, 0 AS step, 'state_change' AS event_type, 'new' AS from_state, 'reviewed' AS to_state FROM jobs WHERE state = 'new'
UNION ALL SELECT job_id, CASE WHEN state = 'new' THEN 1 ELSE 0 END, 'detail_view_open', NULL, NULL FROM jobs)""")
def auto_review_events(spark: SparkSession, d: str) -> DataFrame:
    """What opening every posting once would write."""
    return signals.auto_review_events(jobs(spark, d).select("job_id", "state"))


@BOOK.add("""SELECT event_id, CASE WHEN pt = 'detail_view_open' THEN greatest(0, floor((epoch_us(recorded_at) - epoch_us(pa)) / 1000))::BIGINT END AS dwell_ms
FROM (SELECT event_id, event_type, recorded_at, lag(event_type) OVER w AS pt, lag(recorded_at) OVER w AS pa FROM (SELECT DISTINCT * FROM signal_events) WHERE event_type IN ('detail_view_open', 'detail_view_close') AND job_id IS NOT NULL WINDOW w AS (PARTITION BY user_id, job_id ORDER BY recorded_at, event_id)) WHERE event_type = 'detail_view_close'""")
def dwell_ms(spark: SparkSession, d: str) -> DataFrame:
    """Dwell times from pairs of open and close."""
    return signals.dwell_times(events(spark, d))


@BOOK.add(f"""WITH c AS (SELECT event_id, job_id, from_state, to_state FROM signal_events WHERE {MOVED_SQL} UNION ALL SELECT NULL, job_id, state, 'new' FROM jobs WHERE state IN ('applied', 'dismissed'))
SELECT event_id, job_id, from_state, to_state, step::INTEGER AS step, written FROM (
SELECT *, 0 AS step, CASE to_state WHEN 'applied' THEN 'mark_applied' ELSE 'mark_dismissed' END AS written FROM c WHERE to_state IN ('applied', 'dismissed')
UNION ALL SELECT *, CASE WHEN to_state IN ('applied', 'dismissed') THEN 1 ELSE 0 END, 'state_change' FROM c
UNION ALL SELECT *, 1, CASE from_state WHEN 'applied' THEN 'un_apply' ELSE 'un_dismiss' END FROM c WHERE to_state IN ('new', 'reviewed') AND from_state IN ('applied', 'dismissed'))""")
def transition_events(spark: SparkSession, d: str) -> DataFrame:
    """What each recorded move writes, in order, and what taking back every applied or dismissed job would."""
    kept = ["event_id", "job_id", "from_state", "to_state"]
    back = jobs(spark, d).where(F.col("state").isin(*signals.FINAL)).select(F.lit(None).cast("long").alias("event_id"), "job_id", F.col("state").alias("from_state"), F.lit("new").alias("to_state"))
    return signals.transition_events(signals.moves(events(spark, d)).select(*kept).unionByName(back))


@BOOK.add(f"SELECT j.job_id, coalesce(e.s, j.state) AS state FROM jobs j LEFT JOIN {LAST_SQL} e USING (job_id)")
def current_state(spark: SparkSession, d: str) -> DataFrame:
    """Where each job stands after its events."""
    return signals.current_state(jobs(spark, d), events(spark, d))
