"""Row contracts: a predicate column each, so that accepted and rejected rows stay one table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed domains.
SOURCES = ("linkedin", "indeed", "google")
SIGNAL_TYPES = ("state_change", "detail_view_open", "detail_view_close", "override_inferred")
SPECIALTY_SOURCES = ("seed", "config", "proposed")


def raw_posting(source: Column, url: Column, description: Column, *required: Column) -> Column:
    """Required fields present, a known source, url and description not empty."""
    ok = source.isin(*SOURCES) & (F.length(url) >= 1) & (F.length(description) >= 1)
    for c in required:
        ok = ok & c.isNotNull()
    return F.coalesce(ok, F.lit(False))


def salary_range(low: Column, high: Column) -> Column:
    """Both at least 0, the upper not below the lower."""
    return F.coalesce((low >= 0) & (high >= 0) & (high >= low), F.lit(False))


def chunk(start: Column, end: Column, letters: Column, order: Column) -> Column:
    """A stretch of a document, of at least one letter."""
    return F.coalesce((start >= 0) & (end > start) & (letters >= 1) & (order >= 0), F.lit(False))


def signal(event_type: Column, dwell_ms: Column) -> Column:
    """A known type, and a dwell time that is unknown or not negative."""
    return F.coalesce(event_type.isin(*SIGNAL_TYPES) & (dwell_ms.isNull() | (dwell_ms >= 0)), F.lit(False))


def specialty(name: Column, source: Column) -> Column:
    """A name and a known source."""
    return F.coalesce((F.length(name) >= 1) & source.isin(*SPECIALTY_SOURCES), F.lit(False))


def draft(bullets: Column) -> Column:
    """At least one bullet."""
    return F.coalesce(F.size(bullets) >= 1, F.lit(False))
