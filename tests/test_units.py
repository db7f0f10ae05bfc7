"""Problem 5: figures and units of pay."""

import pytest

from millrace.operators import units

PAY = [("CAD", "currency", 1.0), ("USD", "currency", 1.36), ("EUR", "currency", 1.5), ("GBP", "currency", 1.75), ("year", "period", 1.0), ("month", "period", 12.0), ("biweek", "period", 26.0), ("week", "period", 52.0), ("day", "period", 260.0), ("hour", "period", 2080.0)]
RAW = "id string, salary_raw string, salary_currency string, salary_interval string, salary_min_raw double, source string, expected_specialty string, description string, extra int"
JOB = "job_id string, salary_min_cad int, salary_max_cad int, source string, seniority string, description string"
# raw text, currency, interval, structured minimum, description, expected
CASES = [
    ("$45/hr, full-time", None, None, None, "", (93600, 93600)),
    ("CA$30.25 – CA$33.75/h", None, None, None, "", (62920, 70200)),
    ("75 000 $ à 76 000 $ par an", None, None, None, "", (75000, 76000)),
    ("59,00 $ à 72,00 $ de l'heure", None, None, None, "", (122720, 149760)),
    ("US$2,475 - US$3,150 per week", None, None, None, "", (175032, 222768)),
    ("$0.137M–$0.152M CAD", None, None, None, "", (137000, 152000)),
    ("C$8k to 8200 monthly", None, None, None, "", (96000, 98400)),
    ("92-109K USD", None, None, None, "", (125120, 148240)),
    ("161,000–207K CAD", None, None, None, "", (161000, 207000)),
    ("£1.4k and up to £1,725/wk", None, None, None, "", (127400, 156975)),
    ("2,650 to 3,275 CAD every two weeks", None, None, None, "", (68900, 85150)),
    ("3100–3450", "CAD", "weekly", 3100.0, "", (161200, 179400)),
    ("50-63", "USD", "yearly", 50000.0, "", (68000, 85680)),
    ("29 - 31", None, None, None, "Compensation on this page is in Canadian dollars, per hour. You would earn between 29 and 31 Canadian dollars per hour.", (60320, 64480)),
    ("50-60", None, None, None, "Compensation: 50,000 to 60,000 US dollars per year. All amounts are thousands, yearly, in US dollars.", (68000, 81600)),
    ("1800", None, None, None, "The role pays 1,800 euros per week.", (140400, 140400)),
    ("From $142,000", None, None, None, "", (142000, 142000)),
    ("up to 20% bonus", None, None, None, "", None),
    ("5+ years", None, None, None, "", None),
    ("Negotiable", None, None, None, "", None),
    ("", None, None, None, "", None),
    (None, "CAD", "yearly", 5.0, None, None),
]
STORED = [
    (73, 92, "The role pays 73 to 92 Canadian dollars per hour.", (151840, 191360)),
    (182, 197, "Base pay is 182 to 197 thousand Canadian dollars per year.", (182000, 197000)),
    (101000, 101000, "The role pays 101,000 US dollars per year. All amounts are thousands, yearly, in US dollars.", (137360, 137360)),
    (2875, 3525, "Compensation: 2,875 to 3,525 Canadian dollars for every two weeks.", (74750, 91650)),
    (185120, 228800, "Compensation: 89 to 110 Canadian dollars per hour.", (185120, 228800)),
    (66000, None, "Nothing is said.", (66000, 66000)),
    (0, 5, "", None),
    (9999999, 9999999, "", None),
    (None, None, "The role pays 73 Canadian dollars per hour.", None),
]


@pytest.fixture(scope="module")
def answer(spark):
    raw = spark.createDataFrame([(str(k), t, c, i, m, "google", None, d, 1) for k, (t, c, i, m, d, _) in enumerate(CASES)] * 2, RAW)
    jobs = spark.createDataFrame([(str(k), a, b, "google", None, d) for k, (a, b, d, _) in enumerate(STORED)], JOB)
    rows = units.annual_pay(raw, jobs, spark.createDataFrame(PAY, "unit_code string, unit_kind string, factor double")).collect()
    assert len({(r.rec_table, r.rec_id) for r in rows}) == len(rows)
    return {(r.rec_table, r.rec_id): (r.salary_min_cad, r.salary_max_cad) for r in rows}


def test_raw_postings(answer):
    for k, case in enumerate(CASES):
        assert answer.get(("raw_postings", str(k))) == case[-1], case


def test_jobs(answer):
    for k, case in enumerate(STORED):
        assert answer.get(("jobs", str(k))) == case[-1], case


def test_empty_tables(spark):
    out = units.annual_pay(spark.createDataFrame([], RAW), spark.createDataFrame([], JOB), spark.createDataFrame(PAY, "unit_code string, unit_kind string, factor double"))
    assert out.count() == 0


HOURS = [(f"h{k}", f"${30 + k % 40}/hr", None, None, None, "google", None, "", 1) for k in range(300)]
YEARS = [(f"y{k}", f"${60 + k % 40},000 a year", None, None, None, "google", None, "", 1) for k in range(300)]


def test_forest_predicts_units_it_has_seen(spark):
    ready = units.features(units.prepare_postings(spark.createDataFrame(HOURS + YEARS, RAW)), {"CAD": 1.0}, {"hour": 2080.0, "year": 1.0})
    model = units.train(units.labelled_postings(ready), "row_id")
    told = model.predict(units.labelled_postings(ready)).selectExpr("avg(cast(predicted = label as int)) AS a", "min(confidence) AS c").first()
    assert told.a > 0.95 and told.c >= 0.9


def test_the_forest_decides_where_it_is_sure(spark, monkeypatch):
    bare = [("a", "37 - 45", None, None, None, "google", None, "", 1), ("b", "72,000", None, None, None, "google", None, "", 1), ("c", "37", None, "yearly", None, "google", None, "", 1)]
    raw, jobs = spark.createDataFrame(HOURS + YEARS + bare, RAW), spark.createDataFrame([], JOB)
    pay = spark.createDataFrame(PAY, "unit_code string, unit_kind string, factor double")
    of = lambda: {r.rec_id: r for r in units.annual_pay(raw, jobs, pay).where("rec_id IN ('a', 'b', 'c')").collect()}
    got = of()
    # from the magnitude alone: an hourly and a yearly figure
    assert (got["a"].salary_min_cad, got["a"].salary_max_cad, got["a"].route) == (76960, 93600, "confident")
    assert (got["b"].salary_min_cad, got["b"].route) == (72000, "confident")
    monkeypatch.setattr(units, "train", lambda *_: None)
    off = of()
    # without the forest all goes to review, and the order of stated sources says a year
    assert (off["a"].salary_min_cad, off["a"].salary_max_cad, off["a"].route) == (37, 45, "review")
    assert {r.route for r in off.values()} == {"review"}


def test_a_unit_is_found_however_long_its_sentence(spark):
    text = "All amounts are, " + "as we have said before, " * 40 + "in thousands, yearly, in US dollars."
    got = units.read_description(spark.createDataFrame([(text,)], "d string"), "d").first()
    assert (got.u_scale, got.u_currency, got.u_period) == (1000.0, "USD", "year")


def test_pay_is_read_from_the_whole_text(spark):
    got = units.read_pay(spark.createDataFrame([("benefits and more, " * 80 + "CA$45 per hour",)], "t string"), "t").first()
    assert (got.low, got.currency, got.period) == (45.0, "CAD", "hour")
