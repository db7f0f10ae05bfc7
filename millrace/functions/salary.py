"""Salary extraction with the ladder structured fields, range, hourly rate, single figure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours in a year of work, months, the exchange rate, and the range of a plausible year's pay.
HOURS, MONTHS, USD_TO_CAD = 2080, 12, 1.36
LEAST, MOST = 15_000, 1_000_000
# How figures stand in text.
RANGE = r"(?i)\$?\s*(\d[\d,]*(?:\.\d+)?)\s*[Kk]?\s*(?:–|-|to|—)\s*\$?\s*(\d[\d,]*(?:\.\d+)?)\s*[Kk]?"
HOURLY = r"(?i)\$?\s*(\d[\d,]*(?:\.\d+)?)\s*(?:/\s*h(?:r|our)|per\s+hour)"
SINGLE = r"(?i)\$?\s*(\d[\d,]*(?:\.\d+)?)\s*[Kk]?\s*(?:CAD|USD|per\s+year|/\s*yr|annually)?"
THOUSANDS = r"\d\s*[Kk]\b"


def plausible(amount: Column) -> Column:
    """Whether an amount can be a year's pay."""
    return amount.between(LEAST, MOST)


def _amount(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def _pay(low: Column, high: Column, source: str) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), F.lit(source).alias("source"))


def structured(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """Pay from a site's own fields: annualised, US dollars converted, ordered; null if neither end is plausible."""
    factor = F.when(F.lower(interval) == "hourly", HOURS).when(F.lower(interval) == "monthly", MONTHS).otherwise(1)
    usd = F.upper(F.coalesce(F.nullif(currency, F.lit("")), F.lit("CAD"))) == "USD"
    annual = lambda x: F.when(usd, F.bround(F.bround(x * factor) * USD_TO_CAD)).otherwise(F.bround(x * factor))
    a, b = annual(low), annual(F.coalesce(high, low))
    return F.when(low.isNotNull() & (plausible(a) | plausible(b)), _pay(F.least(a, b), F.greatest(a, b), "source_field"))


def range_text(text: Column) -> Column:
    """The first range with a plausible end. Each side looks for its own K; an em dash or ``to`` leaves the left side the whole match."""
    whole = F.regexp_extract_all(text, F.lit(RANGE), F.lit(0))
    ends = F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, F.lit(RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(RANGE), F.lit(2)).alias("b"))

    def read(x: Column) -> Column:
        left = F.regexp_extract(x["m"], r"^[^–-]*", 0)
        right = F.element_at(F.split(F.element_at(F.split(F.element_at(F.split(x["m"], "–"), -1), "-"), -1), "to"), -1)
        low = _amount(x["a"]) * F.when(left.rlike(THOUSANDS), 1000).otherwise(1)
        high = _amount(x["b"]) * F.when(right.rlike(THOUSANDS), 1000).otherwise(1)
        return _pay(F.least(low, high), F.greatest(low, high), "regex")

    return F.get(F.filter(F.transform(ends, read), lambda p: plausible(p["low"]) | plausible(p["high"])), F.lit(0))


def hourly_text(text: Column) -> Column:
    """The first hourly rate from 10 to 500, times the hours of a year."""
    rates = F.filter(F.transform(F.regexp_extract_all(text, F.lit(HOURLY), F.lit(1)), _amount), lambda r: r.between(10, 500))
    annual = F.bround(F.get(rates, F.lit(0)) * HOURS)
    return F.when(annual.isNotNull(), _pay(annual, annual, "regex"))


def single_text(text: Column) -> Column:
    """The largest plausible figure anywhere in the text."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(SINGLE), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(SINGLE), F.lit(1)).alias("a"))
    best = F.array_max(F.filter(F.transform(found, lambda x: _amount(x["a"]) * F.when(x["m"].rlike(THOUSANDS), 1000).otherwise(1)), plausible))
    return F.when(best.isNotNull(), _pay(best, best, "regex"))


def from_text(text: Column) -> Column:
    """Range, hourly rate or single figure, whichever is found first in this order."""
    return F.coalesce(range_text(text), hourly_text(text), single_text(text))


def extract(salary_raw: Column, description: Column, low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """Structured fields first, then salary_raw if it isn't empty, else the description."""
    text = F.coalesce(F.nullif(salary_raw, F.lit("")), description)
    return F.coalesce(structured(low, high, currency, interval), from_text(text))


def parse_raw(salary_raw: Column) -> Column:
    """The older reading: least and largest number of at least 1000."""
    tokens = F.regexp_extract_all(F.regexp_replace(salary_raw, ",", ""), F.lit(r"(\d+(?:\.\d+)?\s*[Kk]?)"), F.lit(1))
    numbers = F.filter(F.transform(tokens, lambda t: F.regexp_extract(t, r"^[\d.]+", 0).try_cast("double") * F.when(t.rlike("[Kk]$"), 1000.0).otherwise(1.0)), lambda v: v >= 1000)
    return F.struct(F.bround(F.array_min(numbers)).cast("long").alias("low"), F.bround(F.array_max(numbers)).cast("long").alias("high"))
