"""Rows of the connectors to raw postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import format_description

#: The nested payload of the job search api.
PAYLOAD = (
    "title string, company_name string, location string, job_id string, description string, job_highlights array<struct<title string, items array<string>>>, "
    "related_links array<struct<text string, link string>>, detected_extensions struct<posted_at string, salary string>"
)


def text_or_null(value: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def number_or_null(value: Column) -> Column:
    """The number, null for NaN."""
    return F.when(~F.isnan(value), value)


def row_to_raw(rows: DataFrame, source: Column) -> DataFrame:
    """A flat scraper row (id, title, company, location, description, job_url, job_url_direct, date_posted, min_amount, max_amount, currency, interval) as a raw posting."""
    low, high = number_or_null(F.col("min_amount")), number_or_null(F.col("max_amount"))
    currency = text_or_null(F.col("currency"))
    pay = F.concat(low.cast("string"), F.lit("–"), F.coalesce(high.cast("string"), F.lit("None")), F.lit(" "), F.coalesce(currency, F.lit("")))
    return rows.select(
        F.coalesce(text_or_null(F.col("id")), F.lit("")).alias("id"), F.coalesce(text_or_null(F.col("title")), F.lit("Untitled")).alias("title"),
        F.coalesce(text_or_null(F.col("company")), F.lit("Unknown Company")).alias("company"), F.coalesce(text_or_null(F.col("location")), F.lit("")).alias("location"), source.alias("source"),
        F.coalesce(text_or_null(F.col("job_url")), text_or_null(F.col("job_url_direct")), F.lit("")).alias("url"),
        F.coalesce(text_or_null(F.col("description")), F.lit("(description not available)")).alias("description"),
        F.when(low.isNotNull(), F.trim(F.regexp_replace(pay, r"^–+|–+$", ""))).alias("salary_raw"), F.coalesce(text_or_null(F.col("date_posted")), F.lit("")).alias("posted_date"),
        low.alias("salary_min_raw"), high.alias("salary_max_raw"), currency.alias("salary_currency"), text_or_null(F.col("interval")).alias("salary_interval"),
    )


def quote(text: Column) -> Column:
    """Percent-encoding that leaves ``/`` and ``~`` and writes a blank as %20."""
    coded = F.url_encode(text)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return coded


def fallback_id(company: Column, title: Column, location: Column) -> Column:
    """16 hex digits of the md5 of company, title and place."""
    return F.substring(F.md5(F.concat_ws("|", company, title, location)), 1, 16)


def payload_to_raw(payloads: DataFrame, column: str) -> DataFrame:
    """JSON payloads of the job search api as raw postings; rows without a description have an empty one and fail validation later."""
    rows = payloads.select(F.from_json(column, PAYLOAD).alias("p")).select("p.*")
    rows = rows.withColumns({"title": F.coalesce(text_or_null(F.col("title")), F.lit("Untitled")), "company": F.coalesce(text_or_null(F.col("company_name")), F.lit("Unknown Company")), "location": F.trim(F.coalesce("location", F.lit("")))})
    link = F.get(F.filter(F.transform("related_links", lambda x: x["link"]), lambda u: u.startswith("http")), F.lit(0))
    search = F.concat(F.lit("https://www.google.com/search?q="), quote(F.concat_ws(" ", "title", "company")), F.lit("&ibp=htl;jobs"))
    items = F.flatten(F.filter(F.transform("job_highlights", lambda h: h["items"]), lambda i: i.isNotNull()))
    text = F.coalesce(F.nullif(F.array_join(items, "\n"), F.lit("")), F.col("description"), F.lit(""))
    return rows.select(
        F.coalesce(F.nullif(F.col("job_id"), F.lit("")), fallback_id(F.col("company"), F.col("title"), F.col("location"))).alias("id"), "title", "company", "location", F.lit("google").alias("source"),
        F.coalesce(link, search).alias("url"), format_description(text).alias("description"), F.col("detected_extensions.salary").alias("salary_raw"), F.coalesce("detected_extensions.posted_at", F.lit("")).alias("posted_date"),
    )


def or_query(terms: Column) -> Column:
    """``"a" OR "b"`` of the distinct terms."""
    return F.array_join(F.transform(F.array_distinct(terms), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
