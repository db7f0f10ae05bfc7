"""Store transforms, event log, sources and the stream."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators import feed, signals, store
from millrace.sources import registry
from millrace.streaming import events as stream


def at(minute, second=0):
    return datetime(2026, 1, 1, 0, minute, second, tzinfo=timezone.utc)


def test_insert_upsert_and_ids(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, id long, v string")
    new = spark.createDataFrame([("b", "n", 2), ("c", "p", 1), ("c", "q", 0)], "k string, v string, o int")
    assert [tuple(r) for r in store.insert_or_ignore(old, new, ["k"], ["o"]).collect()] == [("c", "q", 0)]
    merged = store.upsert(old, new.where("o > 0").select("k", "v"), "k", ["v"]).orderBy("k").collect()
    assert [(r.k, r.id, r.v) for r in merged] == [("a", 1, "x"), ("b", 2, "n"), ("c", None, "p")]
    ids = store.next_ids(spark.range(50).select(F.col("id").alias("k")), 10, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in ids] == list(range(11, 61))


def test_dwell_and_states(spark):
    schema = "event_id long, user_id string, job_id string, event_type string, from_state string, to_state string, specialty_name string, recorded_at timestamp"
    rows = [
        (1, "u", "j", "detail_view_open", None, None, None, at(1)), (2, "u", "j", "detail_view_close", None, None, None, at(1, 8)), (2, "u", "j", "detail_view_close", None, None, None, at(1, 8)), (3, "u", "j", "detail_view_close", None, None, None, at(2)),
        (4, "u", "j", "state_change", "new", "applied", None, at(3)), (5, "u", "j", "state_change", "applied", "new", "ML Engineer", at(4)), (6, "u", None, "detail_view_open", None, None, None, at(5)),
    ]
    events = spark.createDataFrame(rows, schema)
    assert {r.event_id: r.dwell_ms for r in signals.dwell_times(events).collect()} == {2: 8000, 3: None}
    jobs = spark.createDataFrame([("j", "reviewed"), ("k", "new")], "job_id string, state string")
    assert {r.job_id: r.state for r in signals.current_state(jobs, events).collect()} == {"j": "new", "k": "new"}
    written = [(r.event_id, r.step, r.written) for r in signals.transition_events(events.where("event_type = 'state_change'")).orderBy("event_id", "step").collect()]
    assert written == [(4, 0, "mark_applied"), (4, 1, "state_change"), (5, 0, "state_change"), (5, 1, "un_apply")]
    assert [(r.job_id, r.step, r.event_type) for r in signals.auto_review_events(jobs).orderBy("job_id", "step").collect()] == [("j", 0, "detail_view_open"), ("k", 0, "state_change"), ("k", 1, "detail_view_open")]


def test_feed_order(spark):
    rows = [("a", "u", "new", at(1), 50000), ("b", "u", "new", at(1), 120000), ("c", "u", "new", at(1), None), ("d", "u", "dismissed", at(9), 1), ("e", "u", "new", None, 1), ("f", "v", "new", at(9), 1)]
    jobs = spark.createDataFrame(rows, "job_id string, user_id string, state string, posted_at timestamp, salary_min_cad int")
    assert [r.job_id for r in feed.list_jobs(jobs, "u").collect()] == ["b", "a", "c", "e"]
    assert [r.job_id for r in feed.list_jobs(jobs, "u", limit=2, offset=2).collect()] == ["c", "e"]


def test_registry_isolates_failures(spark):
    rows = spark.createDataFrame([("1", "google", "u", 1), ("2", "google", "u", 0), ("3", "google", "", 2), ("4", "google", " ", 3)], "id string, source string, url string, o int")

    class Broken(registry.JobSource):
        name = "indeed"

        def fetch(self, spark, terms):
            raise RuntimeError("429 too many requests")

    book = registry.Registry()
    book.register(registry.CapturedSource("google", rows))
    book.register(Broken())
    found, status = book.fetch_all(spark, [], ["google", "nobody", "indeed"])
    assert found.count() == 4 and [s[:2] for s in status] == [("google", "ok"), ("indeed", "rate_limited")]
    assert sorted(r.id for r in registry.first_urls(rows, ["url"], ["o"]).collect()) == ["2", "3", "4"]
    assert registry.load_yaml("/nowhere.yaml") == {}


def test_stream_drops_repeats(spark, tmp_path):
    rows = [(k % 30, "u", "j", "mark_applied", None, None, None, None, None, None, at(k % 30)) for k in range(60)]
    spark.createDataFrame(rows, stream.EVENT).write.parquet(str(tmp_path / "in"))
    query = stream.append_events(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    counts = stream.daily_counts(spark.createDataFrame(rows, stream.EVENT)).collect()
    assert [r["count"] for r in counts] == [60]


@pytest.mark.parametrize("user", ["local"])
def test_cascade(spark, user):
    tables = {
        "jobs": spark.createDataFrame([("a", "local"), ("b", "other")], "job_id string, user_id string"),
        "classifications": spark.createDataFrame([("a", "local"), ("b", "other")], "job_id string, user_id string"),
        "duplicates": spark.createDataFrame([("a", "x"), ("x", "a"), ("b", "y")], "duplicate_post_id string, canonical_post_id string"),
        "signal_events": spark.createDataFrame([("a", "local"), ("b", "local"), ("a", "other"), (None, "local")], "job_id string, user_id string"),
    }
    left = store.delete_user(tables, user)
    assert {n: t.count() for n, t in left.items()} == {"jobs": 1, "classifications": 1, "duplicates": 1, "signal_events": 3}
