"""Problem 3: notations, zones, clock changes, and what fixes no moment."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators.timestamps import normalise_timestamps, posting_instants

SEEN = datetime(2025, 5, 18, 13, 26, 31, tzinfo=timezone.utc)
CASES = [
    ("2025-04-29T19:54:09.885Z", "America/Toronto", "2025-04-29T19:54:09.885"),
    ("2025-05-11T01:46:11-04:00", "America/Vancouver", "2025-05-11T05:46:11"),
    ("2025-07-21T16:46:13-0700", None, "2025-07-21T23:46:13"),
    ("2025-04-18 23:29:49.023109-04:00", None, "2025-04-19T03:29:49.023109"),
    ("2025-09-21 16:40 EDT", None, "2025-09-21T20:40:00"),
    ("2025-09-18 20:01:58 America/Vancouver", "America/Toronto", "2025-09-19T03:01:58"),
    ("Thu, 06 Mar 2025 05:47:52 -0800", None, "2025-03-06T13:47:52"),
    ("Nov 13, 2025 3:13 AM PST", None, "2025-11-13T11:13:00"),
    ("Mar 26, 2025 12:26 AM", "America/Toronto", "2025-03-26T04:26:00"),
    ("03/05/2026 4:36 PM", "America/Winnipeg", "2026-03-05T22:36:00"),
    ("19-03-2025 03:09", "America/St_Johns", "2025-03-19T05:39:00"),
    ("12-03-2026", "America/Toronto", "2026-03-12T00:00:00"),
    ("11/01/2025", "America/Toronto", "2025-11-01T00:00:00"),
    ("20250627", "America/Toronto", "2025-06-27T00:00:00"),
    ("1752948390", None, "2025-07-19T18:06:30"),
    ("1752791843.220", None, "2025-07-17T22:37:23.220"),
    ("1755220307179", None, "2025-08-15T01:11:47.179"),
    ("1753262345006230", None, "2025-07-23T09:19:05.006230"),
    ("3 septembre 2025", None, "2025-09-03T00:00:00"),
    ("16 août 2025", None, "2025-08-16T00:00:00"),
    ("January 27, 2025", None, "2025-01-27T00:00:00"),
    # a skipped time is read with the offset before the change: 02:13 PST is 10:13 UTC
    ("2025-03-09 02:13", "America/Vancouver", "2025-03-09T10:13:00"),
    # a repeated time too: 01:30 EDT is 05:30 UTC
    ("2025-11-02 01:30", "America/Toronto", "2025-11-02T05:30:00"),
    ("2025-11-02 01:30 EST", "America/Toronto", "2025-11-02T06:30:00"),
    ("2025-07-01 12:00", "America/Regina", "2025-07-01T18:00:00"),
    ("Active 6 DAYS AGO", None, "2025-05-12T13:26:31"),
    ("22h ago", None, "2025-05-17T15:26:31"),
    ("1mo ago", None, "2025-04-18T13:26:31"),
    ("an hour ago", None, "2025-05-18T12:26:31"),
    ("il y a 2 semaines", None, "2025-05-04T13:26:31"),
    ("Just posted", None, "2025-05-18T00:00:00"),
    ("Posted yesterday", None, "2025-05-17T00:00:00"),
    ("30+ days ago", None, None),
    ("2026-13-45", "America/Toronto", None),
    ("0000-00-00", "America/Toronto", None),
    ("02/30/2025", "America/Toronto", None),
    ("2025-01-01 25:00", "America/Toronto", None),
    ("2025-01-01 13:00 PM", "America/Toronto", None),
    ("2025-01-01 10:00 QQT", "America/Toronto", None),
    ("2025-01-01 10:00", None, None),
    ("2025-01-01 10:00", "Mars/Olympus", None),
    ("Recently", None, None),
    ("", "America/Toronto", None),
    (None, "America/Toronto", None),
    ("x" * 100_000, "America/Toronto", None),
]


@pytest.mark.parametrize("session_zone", ["UTC", "America/Vancouver"])
def test_cases_whatever_the_session_zone(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        rows = spark.createDataFrame([(k, t, z, SEEN, "kept") for k, (t, z, _) in enumerate(CASES)], "k int, t string, z string, seen timestamp, posted_us string")
        got = {r.k: r.out for r in normalise_timestamps(rows, "t", "z", "seen", "out").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k, (text, _, want) in enumerate(CASES):
        expected = None if want is None else round(datetime.fromisoformat(want).replace(tzinfo=timezone.utc).timestamp() * 1e6)
        assert got[k] == expected, text


def test_repeats_nulls_empty_and_extra_columns(spark):
    schema = "id string, posted_date string, site_tz string, scraped_at timestamp, posted_us long"
    rows = spark.createDataFrame([("a", "2025-01-01", None, SEEN, 7)] * 3 + [("b", "Closed", None, SEEN, 7), (None, "2025-01-01", None, SEEN, 7), ("c", "yesterday", None, None, 7)], schema)
    assert [tuple(r) for r in posting_instants(rows).collect()] == [("a", 1735689600000000)]
    assert posting_instants(rows.limit(0)).count() == 0
    assert "kept" in normalise_timestamps(rows.withColumn("kept", F.lit(1)), "posted_date", "site_tz", "scraped_at", "posted_us").columns


def test_the_whole_value_is_read(spark):
    schema = "id string, posted_date string, site_tz string, scraped_at timestamp"
    rows = spark.createDataFrame([("a", " " * 250 + "2025-01-01", None, SEEN), ("b", "2025-01-01" + " " * 250 + "or so", None, SEEN)], schema)
    assert [tuple(r) for r in posting_instants(rows).collect()] == [("a", 1735689600000000)]
