"""Filters in which an unknown value passes."""

from pyspark.sql import functions as F

from millrace.operators import filters, validation

POSTING = "title string, location string, is_remote boolean, seniority string, salary_min_cad int, salary_max_cad int, company_employees_label string"


def reasons(spark, rows, **config):
    table = spark.createDataFrame(rows, POSTING)
    return [(r.excluded_reason, r.badges) for r in filters.apply_filters(table, filters.FilterConfig(**config)).collect()]


def test_places(spark):
    kept = ["Vancouver, BC, Canada", "Burnaby, BC", "Surrey, BC, Canada", "Remote", "Canada Remote", "Canada", "Canada (Remote)", "Ontario, Canada", "Toronto, Ontario, Canada"]
    got = reasons(spark, [("t", p, None, "unknown", None, None, None) for p in kept])
    assert all(r is None for r, _ in got)
    out = [("Toronto, ON", None), ("Austin, TX", True), ("New York, NY", True), ("", None), (None, None), ("Winnipeg, Manitoba, Canada", None)]
    got = reasons(spark, [("t", p, r, "unknown", None, None, None) for p, r in out])
    assert all(r for r, _ in got)
    assert got[1][0].endswith("(non-Canadian location)") and got[3][0].startswith("location: (no location)")
    assert reasons(spark, [("t", "", True, "unknown", None, None, None)])[0][0] is None
    assert reasons(spark, [("t", "Nowhere", None, "unknown", None, None, None)], metro_locations=None)[0][0] is None


def test_order_of_reasons_and_badges(spark):
    rows = [("t", "Canada", None, "director", 1, 2, "1 to 10"), ("t", "Canada", None, "unknown", 90000, 115000, "1 to 10"), ("t", "Canada", None, "senior", 90000, 130000, " 1 TO 10 "), ("t", "Canada", None, "senior", None, None, ""), ("t", "Canada", None, "staff", 130000, None, "x")]
    got = reasons(spark, rows, min_salary_cad=120000, max_seniority="principal", company_size_exclude=("1 to 10",))
    assert got[0][0].startswith("Seniority 'director'")
    assert got[1][0] == "Salary $115,000 below floor $120,000"
    assert got[2][0].startswith("Company size")
    assert got[3] == (None, ["Salary unknown", "Size unknown"])
    assert got[4] == (None, [])
    assert reasons(spark, rows[:1], max_seniority="nonsense")[0][0] is None


def test_titles(spark):
    titles = {"Senior Data Scientist": "allowlist", "Data Scientist QA Lead": "allowlist", "Engineer II": "unknown_pass", "": "unknown_pass", "QA Engineer": "denylist", "DevOps Engineer": "denylist", "Marketing Manager": "denylist"}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(filters.title_rule(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == list(titles.values())


def test_contracts(spark):
    one = spark.range(1)
    lit = F.lit
    checks = [
        (validation.raw_posting(lit("google"), lit("u"), lit("d"), lit("x")), True), (validation.raw_posting(lit("google"), lit(""), lit("d")), False), (validation.raw_posting(lit("other"), lit("u"), lit("d")), False),
        (validation.raw_posting(lit("google"), lit("u"), lit("d"), lit(None)), False), (validation.salary_range(lit(5), lit(4)), False), (validation.salary_range(lit(None), lit(4)), False), (validation.chunk(lit(0), lit(0), lit(1), lit(0)), False),
        (validation.signal(lit("state_change"), lit(None).cast("int")), True), (validation.signal(lit("un_apply"), lit(1)), False), (validation.specialty(lit("x"), lit("seed")), True), (validation.draft(F.array()), False),
    ]
    got = one.select(*[c.alias(str(k)) for k, (c, _) in enumerate(checks)]).first()
    assert [got[k] for k in range(len(checks))] == [w for _, w in checks]
