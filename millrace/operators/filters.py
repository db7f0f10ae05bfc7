"""Hard filters in which an unknown value passes with a badge."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places, marks and orders of the default configuration.
METRO = ("vancouver", "burnaby", "richmond", "surrey", "coquitlam", "north vancouver", "west vancouver", "new westminster", "delta", "langley", "maple ridge", "port moody", "port coquitlam", "pitt meadows", "white rock", "abbotsford")
REMOTE_MARKS = ("remote", "work from home", "wfh", "distributed", "anywhere")
NON_CANADIAN = (
    ", tx", ", ny", ", wa", ", or", ", il", ", ma", ", co", ", fl", ", ga", ", nc", ", nj", ", oh", ", mi", ", mn", ", az", ", va", ", pa", ", tn", ", mo", ", in",
    "united states", ", usa", " usa", ", u.s.", "austin", "new york, ny", "san francisco", "seattle, wa", "chicago, il", "boston, ma",
)
LEVEL_ORDER = ("junior", "mid", "senior", "staff", "principal", "director", "vp", "csuite")
TITLE_ALLOW = r"(?i)data\s+scien|machine\s+learning|ml\s+engineer|applied\s+scien|research\s+scien|ai\s+engineer|nlp\s+engineer|computer\s+vision|deep\s+learning|analytics\s+engineer|quantitative\s+analyst|decision\s+scien|data\s+analyst"
TITLE_DENY = r"(?i)\bqa\b|quality\s+assurance|backend\s+engineer|frontend\s+engineer|devops|site\s+reliability|\bsre\b|ux\s+designer|product\s+designer|graphic\s+designer|sales\s+engineer|solutions\s+engineer|account\s+manager|marketing"


@dataclass(frozen=True)
class FilterConfig:
    """None switches a filter off."""

    metro_locations: tuple[str, ...] | None = METRO
    locations: tuple[str, ...] | None = None
    min_salary_cad: float | None = None
    max_seniority: str | None = None
    company_size_exclude: tuple[str, ...] | None = None
    allow_remote: bool = True


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m.lower()) for m in marks], F.lit(False))


def title_rule(title: Column) -> Column:
    """allowlist, denylist or unknown_pass."""
    return F.when(title.rlike(TITLE_ALLOW), "allowlist").when(title.rlike(TITLE_DENY), "denylist").otherwise("unknown_pass")


def non_canadian(location: Column) -> Column:
    """Whether a place names somewhere outside Canada; substrings, so that some Canadian places are hit too."""
    return _holds(F.lower(F.coalesce(location, F.lit(""))), NON_CANADIAN)


def location_reason(location: Column, is_remote: Column, config: FilterConfig) -> Column:
    """Why a place is excluded; null if it passes."""
    active = config.metro_locations if config.metro_locations is not None else config.locations
    if active is None:
        return F.lit(None).cast("string")
    low = F.lower(F.coalesce(location, F.lit("")))
    shown = F.coalesce(F.nullif(location, F.lit("")), F.lit("(no location)"))
    reason = F.concat(F.lit("location: "), shown, F.lit(" not in metro Vancouver or remote-CA"))
    remote = F.coalesce(is_remote, F.lit(False)) | _holds(low, REMOTE_MARKS)
    abroad = non_canadian(location)
    branch = F.when(_holds(low, tuple(active)), F.lit(None).cast("string")).when(low.contains("canada") & ~abroad, None)
    if config.allow_remote:
        branch = branch.when(remote & abroad, F.concat(reason, F.lit(" (non-Canadian location)"))).when(remote, None)
    return branch.otherwise(reason)


def level_rank(level: Column) -> Column:
    """Position in LEVEL_ORDER, -1 for unknown."""
    return F.coalesce(*[F.when(level == n, F.lit(k)) for k, n in enumerate(LEVEL_ORDER)], F.lit(-1))


def seniority_reason(level: Column, config: FilterConfig) -> Column:
    """Why a level is excluded; unknown levels pass, an unknown ceiling switches the filter off."""
    if config.max_seniority not in LEVEL_ORDER:
        return F.lit(None).cast("string")
    over = level_rank(level) >= LEVEL_ORDER.index(config.max_seniority)
    return F.when(over, F.concat(F.lit("Seniority '"), level, F.lit(f"' meets or exceeds max '{config.max_seniority}'")))


def salary_reason(low: Column, high: Column, config: FilterConfig) -> Column:
    """Why pay is excluded: its upper end lies below the floor."""
    if config.min_salary_cad is None:
        return F.lit(None).cast("string")
    best = F.greatest(low, high)
    return F.when(best < config.min_salary_cad, F.concat(F.lit("Salary $"), F.format_number(best.cast("double"), 0), F.lit(f" below floor ${config.min_salary_cad:,.0f}")))


def size_reason(label: Column, config: FilterConfig) -> Column:
    """Why a company size is excluded."""
    if config.company_size_exclude is None:
        return F.lit(None).cast("string")
    inside = F.lower(F.trim(label)).isin([s.strip().lower() for s in config.company_size_exclude])
    return F.when(inside, F.concat(F.lit("Company size '"), label, F.lit("' is in exclude list")))


def apply_filters(postings: DataFrame, config: FilterConfig) -> DataFrame:
    """``postings`` with ``excluded_reason`` (null: kept) and, for kept rows, sorted ``badges``; the first reason in the order place, level, pay, size counts."""
    reason = F.coalesce(
        location_reason(F.col("location"), F.col("is_remote"), config), seniority_reason(F.col("seniority"), config),
        salary_reason(F.col("salary_min_cad"), F.col("salary_max_cad"), config), size_reason(F.col("company_employees_label"), config),
    )
    none = F.lit(None).cast("string")
    pay = F.when(F.col("salary_min_cad").isNull() & F.col("salary_max_cad").isNull(), "Salary unknown") if config.min_salary_cad is not None else none
    size = F.when(F.coalesce("company_employees_label", F.lit("")) == "", "Size unknown") if config.company_size_exclude is not None else none
    flagged = postings.withColumn("excluded_reason", reason)
    return flagged.withColumn("badges", F.when(F.col("excluded_reason").isNull(), F.array_sort(F.array_compact(F.array(pay, size)))))


def reason_kind(reason: Column) -> Column:
    """kept, location, seniority, salary or size."""
    return F.when(reason.isNull(), "kept").when(reason.startswith("location"), "location").when(reason.startswith("Seniority"), "seniority").when(reason.startswith("Salary"), "salary").otherwise("size")
