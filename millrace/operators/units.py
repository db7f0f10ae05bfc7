"""Problem 5: pay in mixed units to whole Canadian dollars a year.

Figures, scale, currency and period are read from text with Catalyst
expressions. Where the text names no period, a calibrated forest predicts the
unit from magnitude, source, category and the neighbouring fields. It is
trained and calibrated on rows whose unit is stated. A confident prediction is
converted, all other rows are routed to review and settled by the order of the
stated sources (structured fields, then description, then Canadian dollars a
year).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Labelled rows the forest is trained and calibrated on, at most; a fifth of them calibrates.
TRAINING_ROWS = 12_000
TREES, DEPTH = 16, 10
#: Calibrated probability from which a prediction counts as confident.
CONFIDENT = 0.95
BINS = 10

# How texts name currencies and periods, tried in this order.
CURRENCIES = (
    ("USD", r"us ?\$|\busd\b|\bu\.s\.|\bus dollars?\b|american dollars?"),
    ("EUR", r"€|\beur\b|\beuros?\b"),
    ("GBP", r"£|\bgbp\b|\bpounds?\b|sterling"),
    ("CAD", r"\bca?\$|\bcad\b|canadian|\bcdn\b|\bcan\$"),
)
PERIODS = (
    ("biweek", r"bi-?weekly|(?:every|per|each|for every) (?:two|2|other) weeks?|fortnight|/ ?2 ?w|/ ?bi-?week|aux deux semaines|toutes les deux semaines"),
    ("hour", r"/ ?h(?:r|our)?s?\b|\b(?:per|an|each) h(?:ou)?r\b|\bhourly\b|l['’]heure|par heure|\bp/?h\b"),
    ("day", r"/ ?d(?:ay)?\b|\b(?:per|a|each) day\b|\bdaily\b|per diem|par jour"),
    ("week", r"/ ?w(?:k|eek)?\b|\b(?:per|a|each) (?:week|wk)\b|\bweekly\b|par semaine"),
    ("month", r"/ ?mo(?:nth)?\b|/ ?mth\b|\b(?:per|a|each) month\b|\bmonthly\b|par mois|mensuel"),
    ("year", r"/ ?y(?:r|ear)?\b|/ ?an\b|\b(?:per|a|each) (?:year|yr)\b|\bper annum\b|\bannum\b|\bannual(?:ly)?\b|\byearly\b|\bp\.a\.?|par an(?:née)?\b"),
)
# The intervals of structured fields.
INTERVALS = {"hourly": "hour", "daily": "day", "weekly": "week", "biweekly": "biweek", "monthly": "month", "yearly": "year", "annual": "year"}
#: The classes of the forest: a period and the scale of its figures; the last is an amount that already is Canadian dollars a year.
UNITS = (("hour", 1.0), ("day", 1.0), ("week", 1.0), ("biweek", 1.0), ("month", 1.0), ("year", 1.0), ("year", 1000.0), ("year", 1_000_000.0), ("done", 1.0))
DONE = len(UNITS) - 1

FIGURE = r"(?:\d{1,3}(?:[ ,]\d{3})+(?!\d)(?:\.\d+)?|\d+(?:[.,]\d{1,3})?)"
SCALED = FIGURE + r" ?(?:k\b|m\b|thousand\b|million\b|mille\b)?"
NOT_PAY = r"\d+(?:[.,]\d+)? ?%|\d+ ?\+? ?(?:years?|yrs?|ans)\b|\b401 ?\(?k\)?"
SAID_UNIT = r"(?:amounts shown|on this page|pay is quoted|all amounts|figures for pay|salaries are|rates are|amounts are)[^.]*"
#: Words of which every sentence on units, and every pay sentence, holds one: a cheap test that loses nothing before the patterns.
UNIT_WORDS = ("amounts", "page", "quoted", "figures", "salaries", "rates")
MONEY_WORDS = ("dollar", "euro", "pound", "cad", "usd", "eur", "gbp")
SAID_MONEY = r"canadian dollars?|us dollars?|american dollars?|dollars?|euros?|british pounds?|pounds?(?: sterling)?|cad|usd|eur|gbp"
SAID_PERIOD = r"(?:per|an?|for every|every|each) (?:two weeks|2 weeks|other week|hour|day|week|month|year|annum)|hourly|daily|weekly|biweekly|monthly|yearly|annually"
SAID_PAY = rf"({FIGURE})(?: ?(?:to|-|and) ?({FIGURE}))? ?(thousand |million |k )?(?:{SAID_MONEY}),? (?:{SAID_PERIOD})"


def _first(text: Column, named: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in named])


def _tidy(text: Column) -> Column:
    """Lower case with plain spaces and dashes."""
    low = F.translate(F.lower(text), "   –—−‑", "   ----")
    return F.regexp_replace(F.regexp_replace(low, r"\s+", " "), r" à | and up to | up to ", " to ")


def _amount(figure: Column) -> Column:
    """The value of a written figure: blanks and commas group thousands, a comma before one or two last digits is decimal."""
    bare = F.regexp_extract(figure, FIGURE, 0)
    plain = F.when(bare.rlike(r",\d{1,2}$"), F.regexp_replace(F.regexp_replace(bare, " ", ""), ",", ".")).otherwise(F.regexp_replace(bare, "[ ,]", ""))
    return plain.try_cast("double")


def _scale(figure: Column) -> Column:
    """1, a thousand or a million, from the suffix; null without one."""
    return F.when(figure.rlike(r"(?:\d ?k|thousand|mille)\s*$"), 1e3).when(figure.rlike(r"(?:\d ?m|million)\s*$"), 1e6)


def read_pay(rows: DataFrame, text: str) -> DataFrame:
    """Adds low, high (unscaled), low_scale, high_scale, currency and period as far as ``text`` states them; low is null without a figure."""
    rows = rows.withColumn("_mr_t", _tidy(F.col(text)))
    rows = rows.withColumn("_mr_n", F.regexp_extract_all(F.regexp_replace("_mr_t", NOT_PAY, " "), F.lit(f"({SCALED})"), F.lit(1)))
    rows = rows.withColumns({"_mr_a": F.get("_mr_n", F.lit(0)), "_mr_b": F.get("_mr_n", F.lit(1))})
    rows = rows.withColumns({"low": _amount(F.col("_mr_a")), "high": _amount(F.col("_mr_b")), "low_scale": _scale(F.col("_mr_a")), "high_scale": _scale(F.col("_mr_b")), "currency": _first(F.col("_mr_t"), CURRENCIES), "period": _first(F.col("_mr_t"), PERIODS)})
    shared = F.when(F.col("low_scale").isNull() & (F.col("low") < 1000), F.col("high_scale")).otherwise(F.col("low_scale"))
    return rows.withColumns({"low_scale": F.when(F.col("high").isNull(), F.col("low_scale")).otherwise(shared), "high": F.coalesce("high", "low"), "high_scale": F.when(F.col("_mr_b").isNull(), F.col("low_scale")).otherwise(F.col("high_scale"))}).drop("_mr_t", "_mr_n", "_mr_a", "_mr_b")


def read_description(rows: DataFrame, description: str) -> DataFrame:
    """Adds what the description says: d_low, d_high, d_scale, d_currency, d_period of a pay sentence and u_scale, u_currency, u_period of a sentence on units."""
    any_of = lambda words: reduce(or_, [F.col("_mr_d").contains(w) for w in words])
    rows = rows.withColumn("_mr_d", F.lower(F.col(description)))
    rows = rows.withColumns({"_mr_paid": any_of(MONEY_WORDS), "_mr_united": any_of(UNIT_WORDS)})
    rows = rows.withColumn("_mr_d", F.when(F.col("_mr_paid") | F.col("_mr_united"), _tidy(F.col("_mr_d"))))
    rows = rows.withColumns({"_mr_pay": F.when(F.col("_mr_paid"), F.regexp_extract("_mr_d", SAID_PAY, 0)), "_mr_unit": F.when(F.col("_mr_united"), F.regexp_extract("_mr_d", SAID_UNIT, 0))})
    pay, unit = F.col("_mr_pay"), F.col("_mr_unit")
    return rows.withColumns(
        {
            "d_low": _amount(F.regexp_extract(pay, SAID_PAY, 1)), "d_high": _amount(F.regexp_extract(pay, SAID_PAY, 2)), "d_scale": F.when(pay.contains("thousand"), 1e3).when(pay.contains("million"), 1e6).when(pay != "", 1.0),
            "d_currency": _first(pay, CURRENCIES), "d_period": _first(pay, PERIODS),
            "u_scale": F.when(unit.contains("thousand"), 1e3).when(unit.contains("million"), 1e6).when(unit != "", 1.0), "u_currency": _first(unit, CURRENCIES), "u_period": _first(unit, PERIODS),
        }
    ).drop("_mr_d", "_mr_paid", "_mr_united", "_mr_pay", "_mr_unit")


def _code(value: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.when(value == n, F.lit(float(k + 1))) for k, n in enumerate(names)], F.lit(0.0))


FEATURES = ["f_low", "f_ratio", "f_interval", "f_currency", "f_structured", "f_unit_period", "f_unit_scale", "f_said_period", "f_said_ratio", "f_said_annual", "f_stored", "f_source", "f_category"]
PERIOD_NAMES = [p for p, _ in PERIODS]
CURRENCY_NAMES = [c for c, _ in CURRENCIES]


def _known(value: Column, units: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(value == name, F.lit(float(x))) for name, x in units.items()], F.lit(None).cast("double"))


def features(rows: DataFrame, currencies: dict[str, float], periods: dict[str, float]) -> DataFrame:
    """Adds the forest's features; needs low, high, their suffixes, interval, stated_currency, structured_low, source, category, stored and what the description says."""
    log = lambda c: F.when(c > 0, F.log10(c)).otherwise(-1.0)
    ratio = lambda a, b: F.coalesce(F.when((a > 0) & (b > 0), F.round(F.log10(a / b), 1)), F.lit(-9.0))
    low = F.col("low") * F.coalesce("low_scale", F.lit(1.0))
    said = F.col("d_low") * F.col("d_scale")
    return rows.withColumns(
        {
            "f_low": F.coalesce(log(low), F.lit(-1.0)), "f_ratio": ratio(F.col("high") * F.coalesce("high_scale", F.lit(1.0)), low), "f_interval": _code(F.col("interval"), PERIOD_NAMES), "f_currency": _code(F.col("stated_currency"), CURRENCY_NAMES),
            "f_structured": ratio(F.col("structured_low"), low), "f_unit_period": _code(F.col("u_period"), PERIOD_NAMES), "f_unit_scale": F.coalesce(F.log10("u_scale"), F.lit(-1.0)), "f_said_period": _code(F.col("d_period"), PERIOD_NAMES),
            "f_said_ratio": ratio(said, low), "f_said_annual": ratio(said * _known(F.coalesce("d_currency", F.lit("CAD")), currencies) * _known(F.coalesce("d_period", F.lit("year")), periods), low),
            "f_stored": F.col("stored").cast("double"), "f_source": _code(F.col("source"), ["linkedin", "indeed", "google"]), "f_category": F.pmod(F.xxhash64(F.coalesce("category", F.lit(""))), F.lit(16)).cast("double"),
        }
    )


@dataclass
class UnitModel:
    """The forest and its calibration: the share of right predictions in each tenth of its own probability."""

    forest: PipelineModel | object
    assembler: VectorAssembler
    calibration: list[float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds predicted (index into UNITS) and confidence (calibrated)."""
        out = self.forest.transform(self.assembler.transform(rows)).withColumn("_mr_p", vector_to_array("probability"))
        top = F.array_max("_mr_p")
        steps = F.array(*[F.lit(c) for c in self.calibration])
        return out.withColumns({"predicted": F.col("prediction").cast("int"), "confidence": F.get(steps, F.least(F.floor(top * BINS), F.lit(BINS - 1)).cast("int"))}).drop("features", "rawPrediction", "probability", "prediction", "_mr_p")


def train(labelled: DataFrame, key: str) -> UnitModel | None:
    """A forest trained on the rows with the smallest hashes of ``key``, TRAINING_ROWS at most, and calibrated on a fifth of them held out.

    ``labelled`` has the features and ``label``. Fewer than two labels give None.
    """
    sample = cut(labelled.select(key, "label", *FEATURES).orderBy(F.xxhash64(key), "label").limit(TRAINING_ROWS))
    held_out = F.pmod(F.xxhash64(F.lit("held out"), key), F.lit(5)) == 0
    if sample.where(~held_out).select("label").dropDuplicates().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=7, cacheNodeIds=False)
    fitted = forest.fit(assembler.transform(sample.where(~held_out)))
    width = fitted.numClasses
    raw = fitted.transform(assembler.transform(sample.where(held_out))).select("label", "prediction", F.array_max(vector_to_array("probability")).alias("top"))
    rows = raw.groupBy(F.least(F.floor(F.col("top") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("int")).alias("right")).collect()
    seen = {r.bin: (r.right, r.n) for r in rows}
    # shares smoothed towards the middle of the bin, then made to rise
    steps, high = [], 0.0
    for b in range(BINS):
        right, n = seen.get(b, (0, 0))
        high = max(high, (right + 2 * (b + 0.5) / BINS) / (n + 2))
        steps.append(high)
    assert width >= 2
    return UnitModel(fitted, assembler, steps)


def unit_tables(pay_units: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Factors of currencies and periods; a list of more than a thousand units is refused."""
    rows = pay_units.limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("pay_units is too long to be sent to every task")
    kind = lambda k: {r.unit_code: r.factor for r in rows if r.unit_kind == k}
    return kind("currency"), kind("period")


def prepare_postings(postings: DataFrame) -> DataFrame:
    """Raw postings with a pay figure, with all that is stated about their unit; s_period and s_scale are what the order of stated sources says, null where nothing is stated."""
    needed = postings.select("id", "salary_raw", "salary_currency", "salary_interval", "salary_min_raw", "source", "expected_specialty", "description").where(F.col("id").isNotNull() & F.col("salary_raw").rlike(r"\d"))
    rows = read_pay(needed, "salary_raw").where("low IS NOT NULL")
    interval = F.coalesce(*[F.when(F.lower("salary_interval") == k, F.lit(v)) for k, v in INTERVALS.items()])
    rows = read_description(rows, "description").select("*", interval.alias("interval"), F.upper("salary_currency").alias("stated_currency"), F.col("salary_min_raw").alias("structured_low"), F.col("expected_specialty").alias("category"), F.lit(0).alias("stored"))
    near = lambda x, y: F.abs(x / y - 1) < 0.02
    structured_scale = F.when((F.col("structured_low") > 0) & near(F.col("structured_low"), F.col("low") * 1000), 1e3).when((F.col("structured_low") > 0) & near(F.col("structured_low"), F.col("low")), 1.0).when((F.col("structured_low") > 0) & near(F.col("structured_low"), F.col("low") * 1e6), 1e6)
    said_scale = F.when(near(F.col("d_low") * F.col("d_scale"), F.col("low") * 1000), 1e3).when(near(F.col("d_low") * F.col("d_scale"), F.col("low")), 1.0)
    said = F.coalesce("u_period", "d_period")
    scale = F.when(F.col("interval").isNotNull(), F.coalesce(structured_scale, F.lit(1.0))).when(said.isNotNull(), F.coalesce(F.when(F.col("u_scale") > 1, F.when(F.col("low") < 1000, F.col("u_scale"))), said_scale, F.lit(1.0)))
    # a figure with a suffix has its scale already
    suffix = F.col("low_scale").isNotNull() | F.col("high_scale").isNotNull()
    return rows.withColumns({"s_period": F.coalesce("interval", said), "s_scale": F.when(suffix, 1.0).otherwise(scale)})


def prepare_jobs(jobs: DataFrame, currencies: dict[str, float], periods: dict[str, float]) -> DataFrame:
    """Jobs rows with pay; 0 and 9999999 are placeholders. s_period and s_scale are the unit that the description settles, ``done`` for an amount that isn't its bare figure."""
    filled = jobs.select("job_id", "salary_min_cad", "salary_max_cad", "source", "seniority", "description").where(F.col("job_id").isNotNull() & F.col("salary_min_cad").isNotNull() & ~F.col("salary_min_cad").isin(0, 9999999))
    high = F.when(F.col("salary_max_cad").isin(0, 9999999) | (F.col("salary_max_cad") < F.col("salary_min_cad")), None).otherwise(F.col("salary_max_cad"))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = filled.select(
        "job_id", "source", "description", F.col("seniority").alias("category"), F.col("salary_min_cad").cast("double").alias("low"), F.coalesce(high, "salary_min_cad").cast("double").alias("high"),
        none.alias("interval"), none.alias("stated_currency"), number.alias("structured_low"), number.alias("low_scale"), number.alias("high_scale"), F.lit(1).alias("stored"),
    )
    rows = read_description(rows, "description")
    same = lambda x: F.coalesce(F.abs(F.col("low") - x) < 1, F.lit(False))
    said, said_period = F.col("d_low") * F.col("d_scale"), F.coalesce("d_period", "u_period", F.lit("year"))
    thousands = same(said / 1000) & (F.coalesce("d_period", F.lit("year")) == "year")
    bare = same(F.col("d_low")) | same(said) | thousands
    # a figure without a sentence of its own, beside a sentence on units, is bare if only that unit makes it a year's pay
    u_factor = _known(F.coalesce("u_currency", F.lit("CAD")), currencies) * _known(F.col("u_period"), periods) * F.coalesce("u_scale", F.lit(1.0))
    small = F.coalesce(F.col("d_low").isNull() & F.col("u_period").isNotNull() & (F.col("low") < 15000) & (F.col("low") * u_factor >= 15000), F.lit(False))
    scale = F.when(bare, F.when(same(said), 1.0).otherwise(F.when(thousands, 1000.0).otherwise(F.col("d_scale")))).when(small, F.coalesce("u_scale", F.lit(1.0))).otherwise(1.0)
    return rows.withColumns({"s_period": F.when(bare, said_period).when(small, F.col("u_period")).otherwise("done"), "s_scale": scale})


def _label(period: Column, scale: Column) -> Column:
    return F.coalesce(*[F.when((period == p) & (scale == s), F.lit(float(k))) for k, (p, s) in enumerate(UNITS)])


def labelled_postings(featured: DataFrame) -> DataFrame:
    """Postings whose unit is stated, in their own text or beside it, with its index in UNITS as ``label``."""
    own = F.col("period").isNotNull()
    return featured.withColumn("label", _label(F.coalesce("period", "s_period"), F.when(own, 1.0).otherwise(F.col("s_scale")))).where("label IS NOT NULL").select(F.col("id").alias("row_id"), "label", *FEATURES)


def labelled_jobs(featured: DataFrame) -> DataFrame:
    """Stored amounts whose unit their description settles, with its index in UNITS as ``label``."""
    return featured.withColumn("label", _label(F.col("s_period"), F.col("s_scale"))).where("label IS NOT NULL").select(F.col("job_id").alias("row_id"), "label", *FEATURES)


def _predicted(rows: DataFrame, model: UnitModel | None) -> DataFrame:
    """Adds predicted, confidence, and m_period and m_scale of the predicted unit; all null or 0 without a model."""
    rows = model.predict(rows) if model else rows.withColumns({"predicted": F.lit(None).cast("int"), "confidence": F.lit(0.0)})
    unit = lambda i: F.coalesce(*[F.when(F.col("predicted") == k, F.lit(u[i])) for k, u in enumerate(UNITS)])
    return rows.withColumns({"m_period": unit(0), "m_scale": unit(1)})


def convert_postings(featured: DataFrame, model: UnitModel | None, currencies: dict[str, float], periods: dict[str, float]) -> DataFrame:
    """(id, salary_min_cad, salary_max_cad, unit, route, confidence) of raw postings.

    route is stated where salary_raw names the period, confident where the
    forest's unit is converted, review where it was uncertain and the order of
    the stated sources settled it.
    """
    rows = _predicted(featured, model)
    sure = (F.col("confidence") >= CONFIDENT) & (F.col("predicted") != DONE)
    route = F.when(F.col("period").isNotNull(), "stated").when(sure, "confident").otherwise("review")
    period = F.when(route == "stated", F.col("period")).when(route == "confident", F.col("m_period")).otherwise(F.coalesce("s_period", F.lit("year")))
    suffix = F.col("low_scale").isNotNull() | F.col("high_scale").isNotNull()
    scale = F.when(suffix | (route == "stated"), 1.0).when(route == "confident", F.col("m_scale")).otherwise(F.coalesce("s_scale", F.lit(1.0)))
    currency = F.coalesce("currency", "stated_currency", "u_currency", "d_currency", F.lit("CAD"))
    factor = _known(currency, currencies) * _known(period, periods)
    low = F.col("low") * F.coalesce("low_scale", F.lit(1.0)) * scale * factor
    high = F.col("high") * F.coalesce("high_scale", F.lit(1.0)) * scale * factor
    return rows.select("id", F.rint(F.least(low, high)).cast("long").alias("salary_min_cad"), F.rint(F.greatest(low, high)).cast("long").alias("salary_max_cad"), F.concat_ws(" ", currency, period, scale.cast("int").cast("string")).alias("unit"), route.alias("route"), "confidence")


def convert_jobs(featured: DataFrame, model: UnitModel | None, currencies: dict[str, float], periods: dict[str, float]) -> DataFrame:
    """(job_id, salary_min_cad, salary_max_cad, unit, route, confidence) of jobs.

    The forest says whether an amount already is Canadian dollars a year or a
    bare figure of a unit; a bare figure is converted by that unit and taken
    from the pay sentence where there is one. What it isn't sure of is reviewed
    and settled by what the description settles.
    """
    rows = _predicted(featured, model)
    route = F.when(F.col("confidence") >= CONFIDENT, "confident").otherwise("review")
    period = F.when(route == "confident", F.col("m_period")).otherwise(F.coalesce("s_period", F.lit("done")))
    scale = F.when(route == "confident", F.col("m_scale")).otherwise(F.coalesce("s_scale", F.lit(1.0)))
    said = F.col("d_low").isNotNull()
    currency = F.when(said, F.coalesce("d_currency", "u_currency", F.lit("CAD"))).otherwise(F.coalesce("u_currency", F.lit("CAD")))
    factor = _known(currency, currencies) * _known(period, periods)
    whole = period == "done"
    low = F.when(whole, F.col("low")).otherwise(F.when(said, F.col("d_low") * F.col("d_scale")).otherwise(F.col("low") * scale) * factor)
    high = F.when(whole, F.col("high")).otherwise(F.when(said, F.coalesce("d_high", "d_low") * F.col("d_scale")).otherwise(F.col("high") * scale) * factor)
    unit = F.when(whole, "CAD year").otherwise(F.concat_ws(" ", currency, period))
    return rows.select("job_id", F.rint(F.least(low, high)).cast("long").alias("salary_min_cad"), F.rint(F.greatest(low, high)).cast("long").alias("salary_max_cad"), unit.alias("unit"), route.alias("route"), "confidence")


def annual_pay(postings: DataFrame, jobs: DataFrame, pay_units: DataFrame) -> DataFrame:
    """(rec_table, rec_id, salary_min_cad, salary_max_cad, unit, route, confidence) of raw postings and jobs.

    Null or blank pay, and texts without a figure of pay, give no row; repeated
    ids give one row, that of the smallest amounts.
    """
    currencies, periods = unit_tables(pay_units)
    # both are read once for training and conversion
    raw = cut(features(prepare_postings(postings).drop("description", "salary_raw"), currencies, periods))
    stored = cut(features(prepare_jobs(jobs, currencies, periods).drop("description"), currencies, periods))
    model = train(labelled_postings(raw).unionByName(labelled_jobs(stored)), "row_id")
    both = convert_postings(raw, model, currencies, periods).withColumnRenamed("id", "rec_id").withColumn("rec_table", F.lit("raw_postings")).unionByName(
        convert_jobs(stored, model, currencies, periods).withColumnRenamed("job_id", "rec_id").withColumn("rec_table", F.lit("jobs"))
    )
    one = both.groupBy("rec_table", "rec_id").agg(F.min(F.struct("salary_min_cad", "salary_max_cad", "unit", "route", "confidence")).alias("x"))
    return one.select("rec_table", "rec_id", "x.*").where(F.col("salary_min_cad").isNotNull())
