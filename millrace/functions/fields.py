"""Columns for the single fields of a posting: place, date, url, level, ids, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Province abbreviations and names, in the order in which they are written out.
PROVINCES = {
    "BC": "British Columbia", "ON": "Ontario", "AB": "Alberta", "QC": "Quebec", "MB": "Manitoba", "SK": "Saskatchewan", "NS": "Nova Scotia", "NB": "New Brunswick",
    "NL": "Newfoundland and Labrador", "PE": "Prince Edward Island", "NT": "Northwest Territories", "YT": "Yukon", "NU": "Nunavut",
}
# The patterns of levels in titles, tried in this order (normaliser).
TITLE_LEVELS = (
    ("csuite", r"\bcto\b|\bceo\b|\bcoo\b|\bcso\b|\bc-suite\b|\bchief\b"),
    ("vp", r"\bvp\b|\bvice\s+president\b"),
    ("director", r"\bdirector\b"),
    ("principal", r"\bprincipal\b"),
    ("staff", r"\bstaff\b"),
    ("senior", r"\blead(?!er|ing|s\b)"),
    ("senior", r"\bsenior\b|\bsr\.?\b"),
    ("mid", r"\bmanager\b"),
    ("mid", r"\bmid[\s-]level\b|\bintermediate\b"),
    ("junior", r"\bjunior\b|\bjr\.?\b|\bentry[\s-]?level\b|\bgraduate\b|\bintern\b"),
)
# The patterns of the level service, tried in this order.
SERVICE_LEVELS = (
    ("csuite", r"\bcto\b|\bceo\b|\bcoo\b|\bcso\b|\bc-suite\b|\bchief\b"),
    ("vp", r"\bvp\b|\bvice[\s-]president\b"),
    ("director", r"\bdirector\b"),
    ("principal", r"\bprincipal\b"),
    ("staff", r"\bstaff\b"),
    ("director", r"\bmanager\b|\blead\b|\bhead\s+of\b|\btech\s+lead\b"),
    ("senior", r"\bsenior\b|\bsr\.?\b"),
    ("junior", r"\bjunior\b|\bjr\.?\b|\bentry[\s-]level\b|\bassociate\b|\bintern\b"),
    ("mid", r"\bmid[\s-]level\b|\bintermediate\b|\bii\b|\b2\b"),
)
# Structured levels of the sites.
JOB_LEVELS = {
    "internship": "junior", "entry level": "junior", "associate": "junior", "mid-senior level": "senior", "senior": "senior", "senior level": "senior",
    "director": "director", "executive": "vp", "not applicable": "unknown",
}
# Display labels of sources and specialties.
SOURCE_LABELS = {"linkedin": "(LinkedIn)", "indeed": "(Indeed)", "google": "(Google)"}
SPECIALTY_LABELS = {"data_scientist": "Data Scientist", "ml_engineer": "ML Engineer", "data_engineer": "Data Engineer", "data_analyst": "Data Analyst", "unclassified": "Unclassified"}
METRO_MARKS = r"vancouver|burnaby|richmond|surrey"
NB_HYPHEN = "‑"


def literal_map(pairs: dict[str, str]) -> Column:
    """A map literal."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def standardize_location(location: Column) -> Column:
    """A closing ``, CA`` dropped, province abbreviations after a comma written out, ``, Canada`` added behind a province. Null and empty stay."""
    loc = F.regexp_replace(F.trim(location), r"(?i),\s*CA,?\s*$", "")
    loc = F.trim(F.regexp_replace(F.trim(loc), r",+$", ""))
    for short, full in PROVINCES.items():
        loc = F.regexp_replace(loc, rf"(?i),\s*\b{short}\b", f", {full}")
    names = "|".join(p.lower() for p in PROVINCES.values())
    done = F.when(~loc.rlike(r"(?i)\bCanada\b") & F.lower(loc).rlike(names), F.concat(F.rtrim(loc), F.lit(", Canada"))).otherwise(loc)
    return F.when(location == "", location).otherwise(done)


def malformed_title(title: Column) -> Column:
    """Titles that end in ``- Apply`` or hold ``- City, Province``; the province needs no word end."""
    places = "|".join([*PROVINCES, *[p.replace(" and Labrador", "") for p in PROVINCES.values()]])
    return title.rlike(r"(?i)\s+-\s+Apply(?:\s+Now)?\s*$") | title.rlike(rf"(?i)\s+-\s+[A-Z][a-zA-Z\s]+,\s+(?:{places})")


def parse_posted_date(text: Column, as_of: Column) -> Column:
    """The timestamp a posted date means as seen at ``as_of``; null if none of the known forms fits."""
    day = F.date_trunc("day", as_of)
    found = F.when(text.rlike(r"(?i)\btoday\b|\bjust posted\b"), day).when(text.rlike(r"(?i)\byesterday\b"), day - F.expr("INTERVAL 1 DAY"))
    for unit, seconds in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400), ("week", 7 * 86400), ("month", 30 * 86400)):
        pattern = rf"(?i)(\d+)\s+{unit}"
        n = F.regexp_extract(text, pattern, 1).try_cast("long")
        found = found.when(text.rlike(pattern), F.timestamp_micros(F.unix_micros(as_of) - n * F.lit(seconds * 1_000_000)))
    for shape, form in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^(?i)(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},\s*\d{4}$", "MMMM d, yyyy"), (r"^(?i)[a-z]{3}\s+\d{1,2},\s*\d{4}$", "MMM d, yyyy")):
        tidy = F.regexp_replace(F.regexp_replace(F.initcap(text), r"\s+", " "), r",\s*", ", ") if "MMM" in form else text
        found = found.when(text.rlike(shape), F.try_to_timestamp(tidy, F.lit(form)))
    return found


def url_hostname(url: Column) -> Column:
    """The authority of a url, with user and port; empty if there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def extract_job_id(url: Column) -> Column:
    """The posting's id on its site: a query parameter, else an id at the end of the path, else the last part of the path."""
    keys = [F.nullif(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(k))), F.lit("")) for k in ("jk", "jobId", "job_id", "id")]
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    end = F.nullif(F.regexp_extract(path, r"[/=]([A-Za-z0-9_-]{4,})\??$", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(path, r"(?:^|/)([A-Za-z0-9_-]{3,})/*$", 1), F.lit(""))
    return F.coalesce(*keys, end, last)


def infer_seniority(title: Column, levels: tuple[tuple[str, str], ...] = TITLE_LEVELS) -> Column:
    """The level of the first pattern that matches; unknown if none does."""
    return F.coalesce(*[F.when(title.rlike("(?i)" + pattern), F.lit(level)) for level, pattern in levels], F.lit("unknown"))


def infer_seniority_service(title: Column, job_level: Column) -> Column:
    """A structured level if it is known, else that of the title by the service's patterns."""
    return F.coalesce(F.try_element_at(literal_map(JOB_LEVELS), F.lower(F.trim(job_level))), infer_seniority(title, SERVICE_LEVELS))


def job_id(source: Column, url: Column) -> Column:
    """sha256 of ``source:url`` in hex."""
    return F.sha2(F.concat_ws(":", source, url), 256)


def is_remote(location: Column) -> Column:
    """True for remote places, false for the metro, else null."""
    low = F.lower(location)
    return F.when(low.contains("remote"), True).when(low.rlike(METRO_MARKS), False)


def _thousands(amount: Column) -> Column:
    return F.bround(amount / 1000).cast("long")


def _range_text(low: Column, high: Column) -> Column:
    one = F.concat(F.lit("$"), low.cast("string"), F.lit("K CAD"))
    return F.when(low == high, one).otherwise(F.concat(F.lit("$"), low.cast("string"), F.lit(f"K{NB_HYPHEN}$"), high.cast("string"), F.lit("K CAD")))


def format_salary(low: Column, high: Column) -> Column:
    """``$130K‑$155K CAD``; one figure if both agree, ``Salary unknown`` if neither is known."""
    return F.when(low.isNull() & high.isNull(), "Salary unknown").otherwise(_range_text(_thousands(F.coalesce(low, F.lit(0))), _thousands(F.coalesce(F.nullif(high, F.lit(0)), low, F.lit(0)))))


def format_salary_raw(text: Column) -> Column:
    """The same from a raw text; a text without a number is echoed."""
    bare = F.regexp_replace(text, ",", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"(\d+(?:\.\d+)?\s*[Kk]?)"), F.lit(1))
    numbers = F.transform(tokens, lambda t: F.regexp_extract(t, r"^[\d.]+", 0).try_cast("double") * F.when(t.rlike("[Kk]$"), 1000.0).otherwise(1.0))
    return F.when(text.isNull() | (text == ""), "Salary unknown").when(F.size(numbers) == 0, text).otherwise(_range_text(_thousands(F.array_min(numbers)), _thousands(F.array_max(numbers))))


def card_snippet(description: Column) -> Column:
    """The first 120 characters, with dots if there are more."""
    text = F.coalesce(description, F.lit(""))
    return F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 120), F.lit("..."))).otherwise(text)


def specialty_label(name: Column) -> Column:
    """The display name of an expected specialty; Unclassified by default."""
    return F.coalesce(F.try_element_at(literal_map(SPECIALTY_LABELS), F.lower(name)), F.lit("Unclassified"))
