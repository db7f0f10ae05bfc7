"""Queries of sources, fields, salary, filters and validation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import fields, salary, similarity, text
from millrace.operators import filters, validation
from millrace.plans import pipeline
from millrace.plans.registry import Book
from millrace.session import table
from millrace.sources import mapping, registry

BOOK = Book()
# Terms and places of the default search.
TERMS = ["data scientist", "machine learning engineer", "applied scientist", "data analyst"]
PLACES = ["Vancouver, BC, Canada", "Canada"]
CONFIG = filters.FilterConfig(min_salary_cad=120_000, max_seniority="principal", company_size_exclude=("1 to 10",))


def raw(spark: SparkSession, d: str) -> DataFrame:
    """raw_postings."""
    return table(spark, d, "raw_postings")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """jobs."""
    return table(spark, d, "jobs")


# --- SQL fragments: the operators restated for DuckDB -------------------------------------------------


def norm_sql(x: str) -> str:
    """Normalised text."""
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def bare_sql(x: str) -> str:
    """Text without punctuation."""
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def place_sql(x: str) -> str:
    """Standardised location."""
    loc = rf"trim(regexp_replace(trim(regexp_replace(trim({x}), '(?i),\s*CA,?\s*$', '')), ',+$', ''))"
    for short, full in fields.PROVINCES.items():
        loc = rf"regexp_replace({loc}, '(?i),\s*\b{short}\b', ', {full}', 'g')"
    names = "|".join(p.lower() for p in fields.PROVINCES.values())
    return rf"(SELECT CASE WHEN {x} = '' THEN {x} WHEN NOT regexp_matches(l, '(?i)\bCanada\b') AND regexp_matches(lower(l), '{names}') THEN rtrim(l) || ', Canada' ELSE l END FROM (SELECT {loc} AS l))"


def malformed_sql(x: str) -> str:
    """Whether a title is malformed."""
    places = "|".join([*fields.PROVINCES, *[p.replace(" and Labrador", "") for p in fields.PROVINCES.values()]])
    return rf"(regexp_matches({x}, '(?i)\s+-\s+Apply(?:\s+Now)?\s*$') OR regexp_matches({x}, '(?i)\s+-\s+[A-Z][a-zA-Z\s]+,\s+(?:{places})'))"


def date_sql(x: str, as_of: str) -> str:
    """Microseconds of a posted date."""
    us = f"epoch_us({as_of})"
    branches = [rf"WHEN regexp_matches({x}, '(?i)\btoday\b|\bjust posted\b') THEN {us} - {us} % 86400000000", rf"WHEN regexp_matches({x}, '(?i)\byesterday\b') THEN {us} - {us} % 86400000000 - 86400000000"]
    for unit, seconds in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400), ("week", 604800), ("month", 2592000)):
        branches.append(rf"WHEN regexp_matches({x}, '(?i)(\d+)\s+{unit}') THEN {us} - regexp_extract({x}, '(?i)(\d+)\s+{unit}', 1)::BIGINT * {seconds}000000")
    forms = ", ".join(f"epoch_us(try_strptime({x}, '{f}'))" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%B %d, %Y", "%b %d, %Y"))
    return f"CASE {' '.join(branches)} ELSE coalesce({forms}) END"


def host_sql(x: str) -> str:
    """Authority of a url."""
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def job_key_sql(x: str) -> str:
    """Id of the posting on its site."""
    keys = ", ".join(f"nullif(regexp_extract({x}, '[?&]{k}=([^&#]*)', 1), '')" for k in ("jk", "jobId", "job_id", "id"))
    path = f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return rf"coalesce({keys}, nullif(regexp_extract({path}, '[/=]([A-Za-z0-9_-]{{4,}})\??$', 1), ''), nullif(regexp_extract({path}, '(?:^|/)([A-Za-z0-9_-]{{3,}})/*$', 1), ''))"


def level_sql(x: str, levels) -> str:
    """Level of the first pattern; the lookahead is replaced by masking what it rules out."""
    out = []
    for level, pattern in levels:
        if "(?!" in pattern:
            out.append(rf"WHEN regexp_matches(regexp_replace({x}, '(?i)\blead(er|ing|s\b)', '_', 'g'), '(?i)\blead') THEN '{level}'")
        else:
            out.append(f"WHEN regexp_matches({x}, '(?i){pattern}') THEN '{level}'")
    return f"CASE {' '.join(out)} ELSE 'unknown' END"


def remote_sql(x: str) -> str:
    """Whether a place is remote."""
    return f"CASE WHEN contains(lower({x}), 'remote') THEN true WHEN regexp_matches(lower({x}), '{fields.METRO_MARKS}') THEN false END"


def structured_sql(low: str, high: str, currency: str, interval: str) -> tuple[str, str]:
    """Ends of structured pay, null where it isn't plausible."""
    factor = f"CASE lower({interval}) WHEN 'hourly' THEN 2080 WHEN 'monthly' THEN 12 ELSE 1 END"
    end = lambda v: f"CASE WHEN upper(coalesce(nullif({currency}, ''), 'CAD')) = 'USD' THEN round_even(round_even({v} * ({factor}), 0)::DOUBLE * 1.36, 0)::DOUBLE ELSE round_even({v} * ({factor}), 0)::DOUBLE END"
    a, b = end(low), end(f"coalesce({high}, {low})")
    ok = f"{low} IS NOT NULL AND (({a}) BETWEEN 15000 AND 1000000 OR ({b}) BETWEEN 15000 AND 1000000)"
    return f"CASE WHEN {ok} THEN least({a}, {b}) END", f"CASE WHEN {ok} THEN greatest({a}, {b}) END"


PAY = rf"(?i)\$?\s*(\d[\d,]*(?:\.\d+)?)\s*[Kk]?\s*(?:–|-|to|—)\s*\$?\s*(\d[\d,]*(?:\.\d+)?)\s*[Kk]?"


def range_sql(x: str) -> str:
    """First plausible range as a struct (lo, hi)."""
    right = "string_split(string_split(string_split(m[i], '–')[-1], '-')[-1], 'to')[-1]"
    lo = rf"replace(a[i], ',', '')::DOUBLE * CASE WHEN regexp_matches(regexp_extract(m[i], '^[^–-]*', 0), '\d\s*[Kk]\b') THEN 1000 ELSE 1 END"
    hi = rf"replace(b[i], ',', '')::DOUBLE * CASE WHEN regexp_matches({right}, '\d\s*[Kk]\b') THEN 1000 ELSE 1 END"
    return (
        f"(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'lo': least({lo}, {hi}), 'hi': greatest({lo}, {hi})}}), lambda p: p.lo BETWEEN 15000 AND 1000000 OR p.hi BETWEEN 15000 AND 1000000)[1] "
        f"FROM (SELECT regexp_extract_all({x}, '{PAY}', 0) AS m, regexp_extract_all({x}, '{PAY}', 1) AS a, regexp_extract_all({x}, '{PAY}', 2) AS b))"
    )


def hourly_sql(x: str) -> str:
    """Annual pay of the first plausible hourly rate."""
    return rf"round_even(list_filter(list_transform(regexp_extract_all({x}, '(?i)\$?\s*(\d[\d,]*(?:\.\d+)?)\s*(?:/\s*h(?:r|our)|per\s+hour)', 1), lambda v: replace(v, ',', '')::DOUBLE), lambda r: r BETWEEN 10 AND 500)[1] * 2080, 0)::DOUBLE"


def single_sql(x: str) -> str:
    """Largest plausible figure."""
    p = r"(?i)\$?\s*(\d[\d,]*(?:\.\d+)?)\s*[Kk]?\s*(?:CAD|USD|per\s+year|/\s*yr|annually)?"
    return rf"(SELECT list_max(list_filter(list_transform(range(1, len(m) + 1), lambda i: replace(a[i], ',', '')::DOUBLE * CASE WHEN regexp_matches(m[i], '\d\s*[Kk]\b') THEN 1000 ELSE 1 END), lambda v: v BETWEEN 15000 AND 1000000)) FROM (SELECT regexp_extract_all({x}, '{p}', 0) AS m, regexp_extract_all({x}, '{p}', 1) AS a))"


def extract_sql(keys: str, src: str) -> str:
    """A query of (keys, lo, hi, how) by the whole ladder."""
    a, b = structured_sql("salary_min_raw", "salary_max_raw", "salary_currency", "salary_interval")
    return f"""SELECT {keys}, coalesce(sa, r.lo, h, s) AS lo, coalesce(sb, r.hi, h, s) AS hi, CASE WHEN sa IS NOT NULL THEN 'source_field' WHEN coalesce(r.lo, h, s) IS NOT NULL THEN 'regex' END AS how
    FROM (SELECT *, {range_sql('t')} AS r, {hourly_sql('t')} AS h, {single_sql('t')} AS s, {a} AS sa, {b} AS sb FROM (SELECT *, coalesce(nullif(salary_raw, ''), description) AS t FROM {src}))"""


def thousands_sql(low: str, high: str) -> str:
    """Range of thousands as text."""
    return f"CASE WHEN {low} = {high} THEN '$' || {low} || 'K CAD' ELSE '$' || {low} || 'K{fields.NB_HYPHEN}$' || {high} || 'K CAD' END"


# --- sources ------------------------------------------------------------------------------------------


@BOOK.add("SELECT source, count(*) AS n, count(DISTINCT id) AS n_ids FROM raw_postings GROUP BY source")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    """The captured batch read through the data source plug-in."""
    spark.dataSource.register(registry.CapturedBatch)
    return spark.read.format("captured_batch").load(f"{d}/raw_postings.parquet").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@BOOK.add("""SELECT id, source, url FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY scraped_at, id) AS k FROM raw_postings WHERE coalesce(trim(url), '') <> '') WHERE k = 1
UNION ALL SELECT id, source, url FROM raw_postings WHERE coalesce(trim(url), '') = ''""")
def fetch_multi_url_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first posting of each url of a source."""
    return registry.first_urls(raw(spark, d).select("source", "url", "scraped_at", "id"), ["source", "url"], ["scraped_at", "id"]).select("id", "source", "url")


@BOOK.add("""SELECT location, array_to_string(list_transform(list_sort(list(DISTINCT search_term)), lambda t: '"' || t || '"'), ' OR ') AS query FROM raw_postings WHERE search_term IS NOT NULL AND location IS NOT NULL GROUP BY location""")
def or_query_builder(spark: SparkSession, d: str) -> DataFrame:
    """One query for each place, of all terms searched there."""
    known = raw(spark, d).where("search_term IS NOT NULL AND location IS NOT NULL")
    return known.groupBy("location").agg(F.array_sort(F.collect_set("search_term")).alias("t")).select("location", mapping.or_query(F.col("t")).alias("query"))


@BOOK.add("SELECT DISTINCT source, coalesce(nullif(url, ''), id) AS dedup_key FROM raw_postings")
def fetch_dedup_key(spark: SparkSession, d: str) -> DataFrame:
    """url, else id."""
    return raw(spark, d).select("source", F.coalesce(F.nullif(F.col("url"), F.lit("")), "id").alias("dedup_key")).dropDuplicates()


STRIP = r"nullif(regexp_replace({}, '^\s+|\s+$', '', 'g'), '')"


@BOOK.add(
    f"""SELECT coalesce({STRIP.format('id')}, '') AS id, coalesce({STRIP.format('title')}, 'Untitled') AS title, coalesce({STRIP.format('company')}, 'Unknown Company') AS company, coalesce({STRIP.format('location')}, '') AS location,
    coalesce({STRIP.format('url')}, '') AS url, coalesce({STRIP.format('description')}, '(description not available)') AS description, coalesce({STRIP.format('posted_date')}, '') AS posted_date,
    CASE WHEN salary_min_raw IS NOT NULL THEN trim(trim(salary_min_raw || '–' || coalesce(salary_max_raw::VARCHAR, 'None') || ' ' || coalesce({STRIP.format('salary_currency')}, ''), '–')) END AS salary_raw FROM raw_postings"""
)
def row_to_raw(spark: SparkSession, d: str) -> DataFrame:
    """Flat scraper rows with defaults for what is missing."""
    rows = raw(spark, d).select("id", "title", "company", "location", "description", F.col("url").alias("job_url"), F.lit(None).cast("string").alias("job_url_direct"), F.col("posted_date").alias("date_posted"), F.col("salary_min_raw").alias("min_amount"), F.col("salary_max_raw").alias("max_amount"), F.col("salary_currency").alias("currency"), F.col("salary_interval").alias("interval"), "source")
    return mapping.row_to_raw(rows, F.col("source")).select("id", "title", "company", "location", "url", "description", "posted_date", "salary_raw")


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """Captured Google rows in the nested form of the api: half of the text in highlights."""
    none = F.lit(None).cast("string")
    link = lambda u: F.struct(F.lit("Apply").alias("text"), u.alias("link"))
    body = F.struct(
        "title", F.col("company").alias("company_name"), F.coalesce("location", F.lit("")).alias("location"), none.alias("job_id"), "description",
        F.when(F.col("search_term").isNotNull(), F.array(F.struct(F.lit("Duties").alias("title"), F.split("description", "\n").alias("items")))).alias("job_highlights"),
        F.when(F.col("salary_raw").isNotNull(), F.array(link(F.lit("mailto:x@example.org")), link(F.col("url")))).otherwise(F.array(link(F.lit("mailto:x@example.org")))).alias("related_links"),
        F.struct(F.col("posted_date").alias("posted_at"), F.col("salary_raw").alias("salary")).alias("detected_extensions"),
    )
    return raw(spark, d).where("source = 'google'").select(F.to_json(body).alias("payload"))


FORMAT_SQL = r"regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace({}, '\r|\t| {{2,}}', ' ', 'g'), '\.\s+([A-Z][a-z])', E'.\n\n\\1', 'g'), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), chr(10)), '\n{{3,}}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"


@BOOK.add(
    rf"""SELECT substr(md5(c || '|' || t || '|' || l), 1, 16) AS id, t AS title, c AS company, l AS location,
    CASE WHEN salary_raw IS NOT NULL AND url LIKE 'http%' THEN url ELSE 'https://www.google.com/search?q=' || replace(url_encode(t || ' ' || c), '%2F', '/') || '&ibp=htl;jobs' END AS url, {FORMAT_SQL.format('description')} AS description, salary_raw, posted_date
    FROM (SELECT *, coalesce({STRIP.format('title')}, 'Untitled') AS t, coalesce({STRIP.format('company')}, 'Unknown Company') AS c, trim(coalesce(location, '')) AS l FROM raw_postings WHERE source = 'google')"""
)
def serpapi_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested payloads flattened to raw postings."""
    return mapping.payload_to_raw(payloads(spark, d), "payload").select("id", "title", "company", "location", "url", "description", "salary_raw", "posted_date")


@BOOK.add("SELECT id, substr(md5(company || '|' || title || '|' || coalesce(location, '')), 1, 16) AS fallback_id FROM raw_postings")
def fallback_id_md5(spark: SparkSession, d: str) -> DataFrame:
    """The id of postings that come without one."""
    return raw(spark, d).select("id", mapping.fallback_id(F.col("company"), F.col("title"), F.coalesce("location", F.lit(""))).alias("fallback_id"))


@BOOK.add(f"SELECT id, {FORMAT_SQL.format('description')} AS formatted FROM raw_postings")
def format_description(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions laid out in paragraphs."""
    return raw(spark, d).select("id", text.format_description(F.col("description")).alias("formatted"))


@BOOK.add("SELECT id, source, CASE source WHEN 'linkedin' THEN 0 WHEN 'indeed' THEN 1 ELSE 2 END AS source_order FROM raw_postings WHERE source IN ('linkedin', 'indeed', 'google')")
def source_union(spark: SparkSession, d: str) -> DataFrame:
    """All sources of the registry, in the order of registration."""
    book = registry.Registry()
    for name in registry.CAPS:
        book.register(registry.CapturedSource(name, raw(spark, d)))
    found, _ = book.fetch_all(spark, [])
    return found.select("id", "source", "source_order")




@BOOK.add("""SELECT run_id, s AS source, json_extract_string(source_results_json, '$.' || s || '.status') AS status, json_extract_string(source_results_json, '$.' || s || '.count')::INTEGER AS n
FROM scrape_runs, unnest(['linkedin', 'indeed', 'google']) AS t(s) WHERE json_extract_string(source_results_json, '$.' || s || '.status') IS NOT NULL""")
def source_status(spark: SparkSession, d: str) -> DataFrame:
    """What each source said in each run."""
    read = F.from_json("source_results_json", "map<string, struct<status string, count int, error string>>")
    return table(spark, d, "scrape_runs").select("run_id", F.explode(read).alias("source", "r")).select("run_id", "source", F.col("r.status").alias("status"), F.col("r.count").alias("n")).where(F.col("source").isin(*registry.CAPS))


@BOOK.add(f"SELECT t AS term, p AS location FROM unnest({TERMS}) AS a(t), unnest({PLACES}) AS b(p)")
def term_location_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every term with every place."""
    return registry.term_location_pairs(spark, TERMS, PLACES).select("term", "location")


VALID_SQL = "coalesce(source IN ('linkedin', 'indeed', 'google') AND length(url) >= 1 AND length(description) >= 1 AND id IS NOT NULL AND title IS NOT NULL AND company IS NOT NULL AND posted_date IS NOT NULL, false)"


@BOOK.add(f"SELECT id, {VALID_SQL} AS accepted FROM raw_postings")
def validate_raw(spark: SparkSession, d: str) -> DataFrame:
    """The contract of raw postings."""
    rows = raw(spark, d)
    return rows.select("id", validation.raw_posting(rows.source, rows.url, rows.description, *[F.col(c) for c in pipeline.RAW_REQUIRED]).alias("accepted"))


@BOOK.add(f"SELECT id, url, title FROM raw_postings WHERE {VALID_SQL}")
def replay_scan(spark: SparkSession, d: str) -> DataFrame:
    """A captured JSON batch read again; rows that break the contract are left out."""
    lines = raw(spark, d).select(F.to_json(F.struct(*pipeline.RAW_REQUIRED)).alias("line"))
    rows = lines.select(F.from_json("line", ", ".join(f"{c} string" for c in pipeline.RAW_REQUIRED)).alias("r")).select("r.*")
    return pipeline.split_valid(rows)[0].select("id", "url", "title")


# --- fields -------------------------------------------------------------------------------------------


@BOOK.add(f"SELECT id, {norm_sql('title')} AS title_normalized, {norm_sql('company')} AS company_normalized FROM raw_postings")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Titles and companies normalised."""
    return raw(spark, d).select("id", text.normalize_text(F.col("title")).alias("title_normalized"), text.normalize_text(F.col("company")).alias("company_normalized"))


@BOOK.add(f"SELECT id, {bare_sql('title')} || '|' || {bare_sql('company')} AS fp FROM raw_postings")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of title and company."""
    return raw(spark, d).select("id", text.fingerprint(F.col("title"), F.col("company")).alias("fp"))


@BOOK.add(f"SELECT id, {place_sql('location')} AS location FROM raw_postings")
def standardize_location(spark: SparkSession, d: str) -> DataFrame:
    """Places with provinces written out."""
    return raw(spark, d).select("id", fields.standardize_location(F.col("location")).alias("location"))


@BOOK.add(f"SELECT id, {malformed_sql('title')} AS malformed FROM raw_postings")
def malformed_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are artefacts."""
    return raw(spark, d).select("id", fields.malformed_title(F.col("title")).alias("malformed"))


@BOOK.add(f"SELECT id, {date_sql('posted_date', 'scraped_at')} AS posted_us FROM raw_postings")
def parse_posted_date(spark: SparkSession, d: str) -> DataFrame:
    """Posted dates by the project's own formats, as seen at scraped_at."""
    return raw(spark, d).select("id", F.unix_micros(fields.parse_posted_date(F.col("posted_date"), F.col("scraped_at"))).alias("posted_us"))


@BOOK.add(f"SELECT id, {host_sql('url')} AS url_hostname FROM raw_postings")
def url_hostname(spark: SparkSession, d: str) -> DataFrame:
    """Authorities of urls."""
    return raw(spark, d).select("id", fields.url_hostname(F.col("url")).alias("url_hostname"))


@BOOK.add(f"SELECT id, {job_key_sql('url')} AS source_job_id FROM raw_postings")
def extract_job_id(spark: SparkSession, d: str) -> DataFrame:
    """The sites' own ids."""
    return raw(spark, d).select("id", fields.extract_job_id(F.col("url")).alias("source_job_id"))


@BOOK.add(f"SELECT id, {level_sql('title', fields.TITLE_LEVELS)} AS seniority FROM raw_postings")
def infer_seniority_title(spark: SparkSession, d: str) -> DataFrame:
    """Levels by the normaliser's patterns."""
    return raw(spark, d).select("id", fields.infer_seniority(F.col("title")).alias("seniority"))


@BOOK.add(f"SELECT job_id, CASE WHEN lower(trim(seniority)) IN ('senior', 'director') THEN lower(trim(seniority)) ELSE {level_sql('title', fields.SERVICE_LEVELS)} END AS level FROM jobs")
def infer_seniority_service(spark: SparkSession, d: str) -> DataFrame:
    """Levels by the service: the stored level where it is one of its own names, else the title."""
    return jobs(spark, d).select("job_id", fields.infer_seniority_service(F.col("title"), F.col("seniority")).alias("level"))


@BOOK.add("SELECT id, sha256(source || ':' || url) AS job_id FROM raw_postings")
def job_id_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of postings."""
    return raw(spark, d).select("id", fields.job_id(F.col("source"), F.col("url")).alias("job_id"))


@BOOK.add(f"SELECT id, {remote_sql('location')} AS is_remote FROM raw_postings")
def is_remote(spark: SparkSession, d: str) -> DataFrame:
    """Remote, metro, or unknown."""
    return raw(spark, d).select("id", fields.is_remote(F.col("location")).alias("is_remote"))


TOKENS_SQL = r"list_transform(regexp_extract_all(replace(salary_raw, ',', ''), '(\d+(?:\.\d+)?\s*[Kk]?)', 1), lambda t: regexp_extract(t, '^[\d.]+')::DOUBLE * CASE WHEN regexp_matches(t, '[Kk]$') THEN 1000 ELSE 1 END)"


@BOOK.add(f"SELECT id, round_even(list_min(n), 0)::BIGINT AS low, round_even(list_max(n), 0)::BIGINT AS high FROM (SELECT id, list_filter({TOKENS_SQL}, lambda v: v >= 1000) AS n FROM raw_postings)")
def parse_salary_raw(spark: SparkSession, d: str) -> DataFrame:
    """The older reading of raw pay."""
    return raw(spark, d).select("id", salary.parse_raw(F.col("salary_raw")).alias("p")).select("id", "p.*")


@BOOK.add("SELECT id, {} AS low, {} AS high FROM raw_postings".format(*structured_sql("salary_min_raw", "salary_max_raw", "salary_currency", "salary_interval")))
def salary_structured(spark: SparkSession, d: str) -> DataFrame:
    """Pay from the sites' own fields."""
    p = salary.structured(F.col("salary_min_raw"), F.col("salary_max_raw"), F.col("salary_currency"), F.col("salary_interval"))
    return raw(spark, d).select("id", p.alias("p")).select("id", "p.low", "p.high")


@BOOK.add(f"SELECT id, r.lo AS low, r.hi AS high FROM (SELECT id, {range_sql('salary_raw')} AS r FROM raw_postings)")
def salary_range_text(spark: SparkSession, d: str) -> DataFrame:
    """Ranges in text."""
    return raw(spark, d).select("id", salary.range_text(F.col("salary_raw")).alias("p")).select("id", "p.low", "p.high")


@BOOK.add(f"SELECT id, {hourly_sql('salary_raw')} AS annual FROM raw_postings")
def salary_hourly_text(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rates in text."""
    return raw(spark, d).select("id", salary.hourly_text(F.col("salary_raw")).alias("p")).select("id", F.col("p.low").alias("annual"))


@BOOK.add(f"SELECT id, {single_sql('description')} AS annual FROM raw_postings")
def salary_single_text(spark: SparkSession, d: str) -> DataFrame:
    """The largest plausible figure of a description."""
    return raw(spark, d).select("id", salary.single_text(F.col("description")).alias("p")).select("id", F.col("p.low").alias("annual"))


@BOOK.add(f"SELECT id, round_even(lo, 0)::INTEGER AS salary_min_cad, round_even(hi, 0)::INTEGER AS salary_max_cad, how AS salary_source FROM ({extract_sql('id', 'raw_postings')})")
def extract_salary(spark: SparkSession, d: str) -> DataFrame:
    """The whole ladder."""
    p = salary.extract(*[F.col(c) for c in ("salary_raw", "description", "salary_min_raw", "salary_max_raw", "salary_currency", "salary_interval")])
    return raw(spark, d).select("id", p.alias("p")).select("id", F.bround("p.low").cast("int").alias("salary_min_cad"), F.bround("p.high").cast("int").alias("salary_max_cad"), F.col("p.source").alias("salary_source"))


@BOOK.add(
    f"""SELECT job_id, coalesce(salary_min_cad, trunc(coalesce(r.lo, h, s))::INTEGER)::INTEGER AS salary_min_cad, coalesce(salary_max_cad, trunc(coalesce(r.hi, h, s))::INTEGER)::INTEGER AS salary_max_cad,
    coalesce(salary_source, CASE WHEN coalesce(r.lo, h, s) IS NOT NULL THEN 'regex' END) AS salary_source
    FROM (SELECT *, {range_sql('description')} AS r, {hourly_sql('description')} AS h, {single_sql('description')} AS s FROM jobs)"""
)
def enrich_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Unknown pay of stored jobs read from their descriptions."""
    return pipeline.enrich(jobs(spark, d).select("job_id", "description", "salary_min_cad", "salary_max_cad", "salary_source")).select("job_id", "salary_min_cad", "salary_max_cad", "salary_source")


NORMALISED_SQL = f"""SELECT id AS raw_id, job_id, source_job_id, url_hostname, title_normalized, company_normalized, location, is_remote, posted_us, round_even(lo, 0)::INTEGER AS salary_min_cad, round_even(hi, 0)::INTEGER AS salary_max_cad, how AS salary_source, seniority
FROM ({extract_sql('id, job_id, source_job_id, url_hostname, title_normalized, company_normalized, location, is_remote, posted_us, seniority', f'''(SELECT * REPLACE (place AS location), {remote_sql('place')} AS is_remote FROM (SELECT *, sha256(source || ':' || url) AS job_id, {job_key_sql('url')} AS source_job_id, {host_sql('url')} AS url_hostname, {norm_sql('title')} AS title_normalized, {norm_sql('company')} AS company_normalized,
{place_sql('location')} AS place, {date_sql('posted_date', 'scraped_at')} AS posted_us, {level_sql('title', fields.TITLE_LEVELS)} AS seniority FROM raw_postings WHERE {VALID_SQL} AND NOT {malformed_sql('title')}))''')})"""


@BOOK.add(NORMALISED_SQL)
def normalize_postings(spark: SparkSession, d: str) -> DataFrame:
    """Accepted raw postings as stored postings."""
    rows = pipeline.normalise(pipeline.split_valid(raw(spark, d))[0], F.col("scraped_at"))
    return rows.select("raw_id", "job_id", "source_job_id", "url_hostname", "title_normalized", "company_normalized", "location", "is_remote", F.unix_micros("posted_at").alias("posted_us"), "salary_min_cad", "salary_max_cad", "salary_source", "seniority")


WORDS_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> ''))"


@BOOK.add(f"SELECT job_id, array_to_string(list_sort({WORDS_SQL.format('title')}), ' ') AS tokens, len({WORDS_SQL.format('description')}) AS n_words FROM jobs")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Token sets of titles, sizes of those of descriptions."""
    return jobs(spark, d).select("job_id", F.array_join(F.array_sort(text.tokenize(F.col("title"))), " ").alias("tokens"), F.size(text.tokenize(F.col("description"))).cast("long").alias("n_words"))


PAIRS_SQL = "(SELECT a.job_id, b.job_id AS other_id, a.description AS da, b.description AS db, a.title_normalized || ' ' || a.company_normalized AS ta, b.title_normalized || ' ' || b.company_normalized AS tb FROM jobs a JOIN jobs b ON a.duplicate_of = b.job_id)"


def linked(spark: SparkSession, d: str) -> DataFrame:
    """Linked duplicates with what they repeat."""
    j = jobs(spark, d)
    words = F.concat_ws(" ", "title_normalized", "company_normalized")
    a = j.where("duplicate_of IS NOT NULL").select("job_id", F.col("duplicate_of").alias("other_id"), F.col("description").alias("da"), words.alias("ta"))
    return a.join(j.select(F.col("job_id").alias("other_id"), F.col("description").alias("db"), words.alias("tb")), "other_id")


@BOOK.add(f"SELECT job_id, other_id, round(CASE WHEN len(u) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(u) END, 6) AS jaccard FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM (SELECT job_id, other_id, {WORDS_SQL.format('da')} AS a, {WORDS_SQL.format('db')} AS b FROM {PAIRS_SQL}))")
def jaccard_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Shared words of linked duplicates."""
    return linked(spark, d).select("job_id", "other_id", F.round(text.jaccard(text.tokenize(F.col("da")), text.tokenize(F.col("db"))), 6).alias("jaccard"))


def lcs_sql(a: str, b: str) -> str:
    """LCS length by rows of the table of lengths: the last element of the last row."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, greatest(acc[-1], CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN prev[j] + 1 ELSE prev[j + 1] END)), [0])"
    return f"list_reduce(range(1, length({a}) + 1), lambda prev, i: {row}, list_resize([0], length({b}) + 1, 0))[-1]"


@BOOK.add(f"SELECT job_id, other_id, round(200.0 * {lcs_sql('ta', 'tb')} / (length(ta) + length(tb)), 4) AS ratio FROM {PAIRS_SQL}")
def indel_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of linked duplicates."""
    return linked(spark, d).select("job_id", "other_id", F.round(similarity.indel_ratio("ta", "tb"), 4).alias("ratio"))


SORT_SQL = r"array_to_string(list_sort(list_filter(regexp_split_to_array({}, '\s+'), lambda t: t <> '')), ' ')"


@BOOK.add(f"SELECT job_id, other_id, round(200.0 * {lcs_sql('sa', 'sb')} / (length(sa) + length(sb)), 4) AS ratio FROM (SELECT job_id, other_id, {SORT_SQL.format('ta')} AS sa, {SORT_SQL.format('tb')} AS sb FROM {PAIRS_SQL})")
def token_sort_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of linked duplicates whatever the order of their words."""
    return linked(spark, d).select("job_id", "other_id", F.round(similarity.indel_ratio(text.sorted_tokens(F.col("ta")), text.sorted_tokens(F.col("tb"))), 4).alias("ratio"))


@BOOK.add(f"SELECT job_id, CASE WHEN salary_min_cad IS NULL AND salary_max_cad IS NULL THEN 'Salary unknown' ELSE (SELECT {thousands_sql('a', 'b')} FROM (SELECT round_even(coalesce(salary_min_cad, 0) / 1000, 0)::BIGINT AS a, round_even(coalesce(nullif(salary_max_cad, 0), salary_min_cad, 0) / 1000, 0)::BIGINT AS b)) END AS shown FROM jobs")
def format_salary(spark: SparkSession, d: str) -> DataFrame:
    """Pay as shown on a card."""
    return jobs(spark, d).select("job_id", fields.format_salary(F.col("salary_min_cad"), F.col("salary_max_cad")).alias("shown"))


@BOOK.add(f"SELECT id, CASE WHEN salary_raw IS NULL OR salary_raw = '' THEN 'Salary unknown' WHEN len(n) = 0 THEN salary_raw ELSE (SELECT {thousands_sql('a', 'b')} FROM (SELECT round_even(list_min(n) / 1000, 0)::BIGINT AS a, round_even(list_max(n) / 1000, 0)::BIGINT AS b)) END AS shown FROM (SELECT id, salary_raw, {TOKENS_SQL} AS n FROM raw_postings)")
def format_salary_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw pay as shown on a card."""
    return raw(spark, d).select("id", fields.format_salary_raw(F.col("salary_raw")).alias("shown"))


@BOOK.add("SELECT job_id, CASE WHEN length(description) > 120 THEN substr(description, 1, 120) || '...' ELSE coalesce(description, '') END AS snippet, coalesce(strftime(to_timestamp(epoch_us(posted_at) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%d'), 'N/A') AS posted, coalesce(nullif(location, ''), 'N/A') AS location, CASE source WHEN 'linkedin' THEN '(LinkedIn)' WHEN 'indeed' THEN '(Indeed)' WHEN 'google' THEN '(Google)' END AS source_label FROM jobs")
def card_projection(spark: SparkSession, d: str) -> DataFrame:
    """What a card shows."""
    return jobs(spark, d).select("job_id", fields.card_snippet(F.col("description")).alias("snippet"), F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit("N/A")).alias("posted"), F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit("N/A")).alias("location"), F.try_element_at(fields.literal_map(fields.SOURCE_LABELS), F.col("source")).alias("source_label"))


@BOOK.add("SELECT id, CASE lower(expected_specialty) WHEN 'data_scientist' THEN 'Data Scientist' WHEN 'ml_engineer' THEN 'ML Engineer' WHEN 'data_engineer' THEN 'Data Engineer' WHEN 'data_analyst' THEN 'Data Analyst' ELSE 'Unclassified' END AS specialty FROM raw_postings")
def specialty_label(spark: SparkSession, d: str) -> DataFrame:
    """Display names of specialties."""
    return raw(spark, d).select("id", fields.specialty_label(F.col("expected_specialty")).alias("specialty"))


# --- filters ------------------------------------------------------------------------------------------

TITLE_SQL = f"CASE WHEN regexp_matches(title, '{filters.TITLE_ALLOW}') THEN 'allowlist' WHEN regexp_matches(title, '{filters.TITLE_DENY}') THEN 'denylist' ELSE 'unknown_pass' END"
ANY = lambda x, marks: "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"
LOW = "lower(coalesce(location, ''))"
ABROAD_SQL = ANY(LOW, filters.NON_CANADIAN)
PLACE_REASON_SQL = f"""CASE WHEN {ANY(LOW, filters.METRO)} OR (contains({LOW}, 'canada') AND NOT {ABROAD_SQL}) THEN NULL
WHEN (coalesce(is_remote, false) OR {ANY(LOW, filters.REMOTE_MARKS)}) THEN CASE WHEN {ABROAD_SQL} THEN 'location: ' || coalesce(nullif(location, ''), '(no location)') || ' not in metro Vancouver or remote-CA (non-Canadian location)' END
ELSE 'location: ' || coalesce(nullif(location, ''), '(no location)') || ' not in metro Vancouver or remote-CA' END"""
RANK_SQL = "coalesce(list_position(['junior', 'mid', 'senior', 'staff', 'principal', 'director', 'vp', 'csuite'], seniority), 0)"
LEVEL_REASON_SQL = f"CASE WHEN {RANK_SQL} >= 5 THEN 'Seniority ''' || seniority || ''' meets or exceeds max ''principal''' END"
PAY_REASON_SQL = "CASE WHEN greatest(salary_min_cad, salary_max_cad) < 120000 THEN 'Salary $' || format('{:,.0f}', greatest(salary_min_cad, salary_max_cad)::DOUBLE) || ' below floor $120,000' END"
SIZE_REASON_SQL = "CASE WHEN lower(trim(company_employees_label)) = '1 to 10' THEN 'Company size ''' || company_employees_label || ''' is in exclude list' END"
HARD_SQL = f"""SELECT job_id, reason AS excluded_reason, CASE WHEN reason IS NULL THEN array_to_string(list_filter([CASE WHEN salary_min_cad IS NULL AND salary_max_cad IS NULL THEN 'Salary unknown' END, CASE WHEN coalesce(company_employees_label, '') = '' THEN 'Size unknown' END], lambda b: b IS NOT NULL), ',') END AS badges
FROM (SELECT *, coalesce({PLACE_REASON_SQL}, {LEVEL_REASON_SQL}, {PAY_REASON_SQL}, {SIZE_REASON_SQL}) AS reason FROM jobs)"""


@BOOK.add(f"SELECT id, {TITLE_SQL} AS rule FROM raw_postings")
def title_filter(spark: SparkSession, d: str) -> DataFrame:
    """Which list a title is on."""
    return raw(spark, d).select("id", filters.title_rule(F.col("title")).alias("rule"))


@BOOK.add(f"SELECT job_id, {PLACE_REASON_SQL} AS reason FROM jobs")
def location_filter(spark: SparkSession, d: str) -> DataFrame:
    """Why a place is excluded."""
    return jobs(spark, d).select("job_id", filters.location_reason(F.col("location"), F.col("is_remote"), CONFIG).alias("reason"))


@BOOK.add(f"SELECT job_id, {ABROAD_SQL} AS non_canadian FROM jobs")
def non_canadian(spark: SparkSession, d: str) -> DataFrame:
    """Places outside Canada."""
    return jobs(spark, d).select("job_id", filters.non_canadian(F.col("location")).alias("non_canadian"))


@BOOK.add(f"SELECT job_id, {LEVEL_REASON_SQL} AS reason FROM jobs")
def seniority_filter(spark: SparkSession, d: str) -> DataFrame:
    """Why a level is excluded."""
    return jobs(spark, d).select("job_id", filters.seniority_reason(F.col("seniority"), CONFIG).alias("reason"))


@BOOK.add(f"SELECT job_id, {PAY_REASON_SQL} AS reason FROM jobs")
def salary_filter(spark: SparkSession, d: str) -> DataFrame:
    """Why pay is excluded."""
    return jobs(spark, d).select("job_id", filters.salary_reason(F.col("salary_min_cad"), F.col("salary_max_cad"), CONFIG).alias("reason"))


@BOOK.add(f"SELECT job_id, {SIZE_REASON_SQL} AS reason FROM jobs")
def size_filter(spark: SparkSession, d: str) -> DataFrame:
    """Why a size is excluded."""
    return jobs(spark, d).select("job_id", filters.size_reason(F.col("company_employees_label"), CONFIG).alias("reason"))


@BOOK.add(HARD_SQL)
def hard_filter(spark: SparkSession, d: str) -> DataFrame:
    """All filters, with badges of what passed unknown."""
    return filters.apply_filters(jobs(spark, d), CONFIG).select("job_id", "excluded_reason", F.array_join("badges", ",").alias("badges"))


KIND_SQL = "CASE WHEN excluded_reason IS NULL THEN 'kept' WHEN excluded_reason LIKE 'location%' THEN 'location' WHEN excluded_reason LIKE 'Seniority%' THEN 'seniority' WHEN excluded_reason LIKE 'Salary%' THEN 'salary' ELSE 'size' END"


@BOOK.add(f"SELECT {KIND_SQL} AS kind, count(*) AS n FROM ({HARD_SQL}) GROUP BY 1")
def hard_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each filter takes."""
    return filters.apply_filters(jobs(spark, d), CONFIG).groupBy(filters.reason_kind(F.col("excluded_reason")).alias("kind")).agg(F.count("*").alias("n"))


@BOOK.add(f"SELECT job_id, excluded_reason IS NULL AS kept, {KIND_SQL} AS kind FROM ({HARD_SQL})")
def hard_filter_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of kept and excluded rows."""
    return filters.apply_filters(jobs(spark, d), CONFIG).select("job_id", F.col("excluded_reason").isNull().alias("kept"), filters.reason_kind(F.col("excluded_reason")).alias("kind"))


# --- contracts ----------------------------------------------------------------------------------------


@BOOK.add("SELECT job_id, coalesce(salary_min_cad >= 0 AND salary_max_cad >= 0 AND salary_max_cad >= salary_min_cad, false) AS valid FROM jobs")
def validate_salary_range(spark: SparkSession, d: str) -> DataFrame:
    """Ranges that are ranges."""
    return jobs(spark, d).select("job_id", validation.salary_range(F.col("salary_min_cad"), F.col("salary_max_cad")).alias("valid"))


@BOOK.add("""SELECT doc_id, i - 1 AS order_index, start AS char_start, start + n AS char_end, n >= 1 AS valid FROM (SELECT doc_id, i, length(c) AS n, coalesce(sum(length(c) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS c FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents)))""")
def validate_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents, by paragraph, with where they stand; only lengths are moved."""
    sizes = table(spark, d, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n\n"), F.length)).alias("order_index", "n"))
    before = Window.partitionBy("doc_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("char_start", F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0))).withColumn("char_end", F.col("char_start") + F.col("n"))
    return placed.select("doc_id", F.col("order_index").cast("long").alias("order_index"), "char_start", "char_end", validation.chunk(F.col("char_start"), F.col("char_end"), F.col("n"), F.col("order_index")).alias("valid"))


@BOOK.add("SELECT event_id, coalesce(event_type IN ('state_change', 'detail_view_open', 'detail_view_close', 'override_inferred') AND (dwell_ms IS NULL OR dwell_ms >= 0), false) AS valid FROM signal_events")
def validate_signal(spark: SparkSession, d: str) -> DataFrame:
    """Events the model admits."""
    return table(spark, d, "signal_events").select("event_id", validation.signal(F.col("event_type"), F.col("dwell_ms")).alias("valid"))


@BOOK.add("""SELECT classification_id, coalesce(length(name) >= 1 AND source IN ('seed', 'config', 'proposed'), false) AS valid
FROM (SELECT classification_id, nullif(specialty_name, 'Unclassified') AS name, CASE WHEN confidence = 'low' THEN model_name WHEN prompt_version = 'v1' THEN 'config' ELSE 'proposed' END AS source FROM classifications)""")
def validate_specialty(spark: SparkSession, d: str) -> DataFrame:
    """Specialties with a name and a known source. No table has their source: the version of the prompt stands for it, and the model's name, which is none, where the model was unsure."""
    source = F.when(F.col("confidence") == "low", F.col("model_name")).when(F.col("prompt_version") == "v1", "config").otherwise("proposed")
    return table(spark, d, "classifications").select("classification_id", validation.specialty(F.nullif(F.col("specialty_name"), F.lit("Unclassified")), source).alias("valid"))


@BOOK.add("SELECT classification_id, coalesce(json_array_length(duty_signals) >= 1, false) AS valid FROM classifications")
def validate_draft(spark: SparkSession, d: str) -> DataFrame:
    """Drafts with at least one bullet."""
    return table(spark, d, "classifications").select("classification_id", validation.draft(F.from_json("duty_signals", "array<string>")).alias("valid"))
