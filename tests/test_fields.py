"""Field expressions against published examples."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions import fields, salary, text
from millrace.sources import mapping


def values(spark, column, rows, schema="x string"):
    return [r.y for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column.alias("y")).collect()]


def test_text(spark):
    assert values(spark, text.normalize_text(F.col("x")), ["Fintech Startup — stealth", "Café — ML²/AI", "", None]) == ["fintech startup stealth", "café ml² ai", "", None]
    assert values(spark, text.fingerprint(F.col("x"), F.lit("A.B, Inc")), ["ML/AI  Lead"]) == ["mlai lead|ab inc"]
    assert values(spark, text.format_description(F.col("x")), ["One.  Two\r\n\n\n\nThree. x  ", None]) == ["One.\n\nTwo\n\nThree. x", None]


def test_locations(spark):
    got = values(spark, fields.standardize_location(F.col("x")), ["Burnaby, BC, CA", "Ottawa, ON, CA", "Remote, CA", "San Francisco, CA", "", None, "Toronto, Ontario"])
    assert got == ["Burnaby, British Columbia, Canada", "Ottawa, Ontario, Canada", "Remote", "San Francisco", "", None, "Toronto, Ontario, Canada"]
    assert values(spark, fields.is_remote(F.col("x")), ["Remote", "Burnaby, BC", "Toronto"]) == [True, False, None]


def test_titles(spark):
    assert values(spark, fields.malformed_title(F.col("x")), ["ML Engineer - Apply Now", "Analyst - Vancouver, BC", "Data Analyst - Growth, Onboarding", "Data Analyst - Growth"]) == [True, True, True, False]
    titles = ["Technical Lead", "Lead ML Engineer", "Manager, Data Science", "Director of Analytics", "Chief Data Officer", "VP of Engineering", "Graduate Data Scientist", "Intern, ML", "Leadership Development", "Data Scientist"]
    assert values(spark, fields.infer_seniority(F.col("x")), titles) == ["senior", "senior", "mid", "director", "csuite", "vp", "junior", "junior", "unknown", "unknown"]
    assert values(spark, fields.infer_seniority_service(F.col("x"), F.lit("Mid-Senior level")), ["x"]) == ["senior"]
    assert values(spark, fields.infer_seniority_service(F.col("x"), F.lit(None).cast("string")), ["Data Lead", "Engineer II", "Sr. X"]) == ["director", "mid", "senior"]


def test_urls_and_ids(spark):
    urls = ["https://www.linkedin.com/jobs/view/3901234001", "https://ca.indeed.com/viewjob?jk=a1b2c3d4e5f60001", "https://boards.greenhouse.io/hootsuite/jobs/5550001", "https://u@h.x:8/abc/", "no url", None]
    assert values(spark, fields.extract_job_id(F.col("x")), urls) == ["3901234001", "a1b2c3d4e5f60001", "5550001", "abc", None, None]
    assert values(spark, fields.url_hostname(F.col("x")), urls)[3:] == ["u@h.x:8", "", ""]
    got = values(spark, fields.job_id(F.lit("linkedin"), F.col("x")), urls[:1])[0]
    assert got.startswith("f2ea8316") and got.endswith("a828")


def test_dates(spark):
    as_of = datetime(2026, 4, 20, 12, 30, tzinfo=timezone.utc)
    texts = ["today", "Yesterday", "3 days ago", "2 months ago", "30+ days ago", "2026-04-18", "04/18/2026", "18-04-2026", "April 8, 2026", "Apr 08, 2026", "", None, "soon"]
    got = [r.y and datetime.fromtimestamp(r.y / 1e6, timezone.utc).strftime("%m-%d %H:%M") for r in spark.createDataFrame([(t, as_of) for t in texts], "x string, t timestamp").select(F.unix_micros(fields.parse_posted_date(F.col("x"), F.col("t"))).alias("y")).collect()]
    assert got == ["04-20 00:00", "04-19 00:00", "04-17 12:30", "02-19 12:30", None, "04-18 00:00", "04-18 00:00", "04-18 00:00", "04-08 00:00", "04-08 00:00", None, None, None]


@pytest.mark.parametrize(
    "said, low, high",
    [
        ("Salary: $120K per year", 120000, None), ("Compensation: $120,000 CAD", 120000, None), ("Pay: $90K–$110K", 90000, 110000), ("Range: $90,000-$110,000", 90000, 110000), ("We offer 80K to 100K CAD annually", 80000, 100000),
        ("$45/hr, full-time position", 93600, None), ("Rate: $55 per hour", 114400, None), ("120000 CAD total compensation", 120000, None), ("$150K–$200K annually", 150000, 200000), ("competitive pay", None, None),
        ("", None, None), ("5 years experience required, 80% remote", None, None), ("pay 120 to 150K", 120000, 150000), ("$120–150K", 120, 150000), ("serving 20,000 customers", 20000, None),
    ],
)
def test_salary_text(spark, said, low, high):
    got = values(spark, salary.from_text(F.col("x")), [said])[0]
    # "120 to 150K" keeps its left side whole, so both ends read as thousands
    assert (got and got.low) == low
    if high:
        assert got.high == high


def test_salary_structured(spark):
    schema = "a double, b double, c string, i string"
    pay = salary.structured(F.col("a"), F.col("b"), F.col("c"), F.col("i"))
    rows = [(50.0, None, "CAD", "hourly"), (8000.0, 9000.0, "usd", "monthly"), (5.0, 9.0, None, "yearly"), (None, 9.0, None, None), (120000.0, 90000.0, "", None)]
    got = values(spark, pay, rows, schema)
    assert [(g.low, g.high) if g else None for g in got] == [(104000, 104000), (130560, 146880), None, None, (90000, 120000)]


def test_display(spark):
    rows = [(130000, 155000), (105000, 105000), (None, None), (None, 90000), (62500, 63500)]
    got = values(spark, fields.format_salary(F.col("a"), F.col("b")), rows, "a int, b int")
    assert got == ["$130K‑$155K CAD", "$105K CAD", "Salary unknown", "$0K‑$90K CAD", "$62K‑$64K CAD"]
    assert values(spark, fields.format_salary_raw(F.col("x")), ["$120K", "DOE", None]) == ["$120K CAD", "DOE", "Salary unknown"]
    assert values(spark, fields.card_snippet(F.col("x")), ["a" * 121, None]) == ["a" * 120 + "...", ""]


def test_payload(spark):
    body = '{"title": "ML Engineer", "company_name": "TechCo", "job_highlights": [{"items": ["Build ML models", "Deploy pipelines"]}], "related_links": [{"link": "mailto:a"}, {"link": "https://techco.com/careers/abc123"}], "detected_extensions": {"posted_at": "3 days ago", "salary": "$120K/yr"}}'
    rows = mapping.payload_to_raw(spark.createDataFrame([(body,), ('{"title": "A/B c~*"}',), ("{}",), (None,)], "p string"), "p").collect()
    assert (rows[0].url, rows[0].description, rows[0].salary_raw, len(rows[0].id)) == ("https://techco.com/careers/abc123", "Build ML models\nDeploy pipelines", "$120K/yr", 16)
    assert rows[1].url == "https://www.google.com/search?q=A/B%20c~%2A%20Unknown%20Company&ibp=htl;jobs"
    assert (rows[2].title, rows[2].description) == ("Untitled", "")
