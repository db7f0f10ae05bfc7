"""A whole run over a few postings."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from millrace.plans import runner

RAW = "id string, title string, company string, location string, source string, url string, description string, salary_raw string, posted_date string, user_id string, expected_specialty string, search_term string, salary_min_raw double, salary_max_raw double, salary_currency string, salary_interval string, scraped_at timestamp, site_tz string"
T = datetime(2026, 4, 20, tzinfo=timezone.utc)


def posting(k, title, company="Acme Corp", url=None, place="Vancouver, BC", source="linkedin", text="We need you to build models for $120K a year."):
    return (f"id{k}", title, company, place, source, f"https://x.example/jobs/view/{1000 + k}" if url is None else url, text, None, "2026-04-18", "local", None, None, None, None, None, None, datetime(2026, 4, 20, 0, 0, k, tzinfo=timezone.utc), "UTC")


def test_replay(spark, tmp_path):
    jobs = spark.createDataFrame([], "job_id string, user_id string, source string, source_job_id string, url string, url_hostname string, title string, title_normalized string, company string, company_normalized string, location string, is_remote boolean, posted_at timestamp, description string, salary_min_cad int, salary_max_cad int, salary_source string, seniority string, company_employees_label string, company_size_bucket string, duplicate_of string, fetched_at timestamp, url_health_checked_at timestamp, url_is_dead boolean, state string, state_updated_at timestamp")
    duplicates = spark.createDataFrame([], "duplicate_id long, duplicate_post_id string, canonical_post_id string, match_type string, match_score double, detected_at timestamp")
    classes = spark.createDataFrame([], "classification_id long, job_id string, user_id string, specialty_name string, confidence string, duty_signals string, model_name string, prompt_version string, classified_at timestamp")
    rows = [
        posting(1, "Senior Data Scientist"), posting(2, "Data Scientist, Senior", source="indeed"), posting(3, "ML Engineer", "Watershed AI"), posting(4, "QA Engineer"), posting(5, "Data Analyst", place="Austin, TX"),
        posting(6, "Chef - Apply Now"), posting(7, "Data Engineer", url=""), posting(8, "Principal Data Scientist", "Loblaws", url="https://x.example/jobs/view/1003", source="google", text="Another text."),
    ]
    raw = spark.createDataFrame(rows, RAW)
    said = []
    done = runner.replay(raw, jobs, duplicates, classes, "2026-04-20 00:00:00", log_folder=runner.run_folder(str(tmp_path)), status=said.append)
    assert done.counts == {"fetched": 8, "normalised": 6, "passed_filters": 5, "passed_titles": 4, "distinct_jobs": 4, "clusters": 4, "canonical": 2, "duplicates": 1, "within_run": 1, "stored": 3}
    assert done.errors == [] and said[-1] == "store"
    kept = {r.title: r for r in done.jobs.collect()}
    assert kept["Data Scientist, Senior"].duplicate_of == kept["Senior Data Scientist"].job_id
    assert kept["ML Engineer"].salary_min_cad == 120000
    assert [(r.duplicate_id, r.match_type, r.match_score) for r in done.duplicates.collect()] == [(1, "fuzzy_title_company", 1.0)]
    assert sorted(r.classification_id for r in done.classifications.collect()) == [1, 2]
    again = runner.replay(raw, done.jobs, done.duplicates, done.classifications, "2026-04-21 00:00:00")
    assert again.counts["stored"] == 0 and again.counts["canonical"] == 0


def test_replay_searches_no_table_at_the_floor(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a search at the floor")

    plain = runner.dedup.fuzzy_join
    monkeypatch.setattr(runner.dedup, "closest", refuse)
    monkeypatch.setattr(runner.dedup, "fuzzy_join", lambda a, b, threshold: refuse() if threshold < runner.dedup.CLUSTER_AT else plain(a, b, threshold))
    existing = spark.createDataFrame([("old", -1, "u", "analyst data senior acme corp", "We need you to build models for $120K a year.")], "old_id string, rank long, url string, text string, description string")
    texts = [("a", "data analyst acme corp", "We need you to build models for $110K a year."), ("b", "data analyst acme corps", "Nothing alike."), ("c", "data analyst of acme corps", "Something else here.")]
    kept = spark.createDataFrame([(k, t, None, f"u{k}", d, datetime(2026, 4, 20, 0, 0, n, tzinfo=timezone.utc)) for n, (k, t, d) in enumerate(texts)], "job_id string, title_normalized string, company_normalized string, url string, description string, scraped_at timestamp")
    old = existing.select(F.col("old_id").alias("job_id"), F.col("text").alias("title_normalized"), F.lit(None).cast("string").alias("company_normalized"), "url", "description", F.lit(datetime(2026, 4, 1, tzinfo=timezone.utc)).alias("fetched_at"))
    got = {r.new_id: (r.decision, r.canonical_id) for r in runner.pipeline.check_history(kept, old).collect()}
    assert got == {"a": ("description_similarity", "old"), "b": ("canonical", None), "c": ("fuzzy_title_company", "b")}


def test_health_and_switches(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "url string")
    assert {r.url: r.url_is_dead for r in runner.url_health(urls).collect()} == {"a": None, "b": None}
    assert {r.url: r.url_is_dead for r in runner.url_health(urls, lambda u: u == "a").collect()} == {"a": False, "b": True}
    assert runner.head_is_fine("http://127.0.0.1:9/none") is False
    on = runner.set_enabled(spark.createDataFrame([("x", False), ("y", True)], "name string, enabled boolean"), "x", True)
    assert {r.name: r.enabled for r in on.collect()} == {"x": True, "y": True}
