"""Problem 3: timestamps of mixed notation, precision and zone to one UTC instant.

An ordered cascade of anchored patterns rewrites each notation into the same
nine parts (year, month, day, hour, minute, second, fraction, half of day,
zone); the parts are then read once, strictly. Everything is a Column
expression, so the work stays inside the JVM and needs no shuffle.

Policy for local times: a wall time that a clock change skips or repeats is
read with the offset in force before the change. That is what
``to_utc_timestamp`` does: a skipped time moves on by the length of the gap, a
repeated one takes the earlier instant.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets in minutes of the Canadian zone abbreviations.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Names of zones without a season.
ZONE_NAMES = {"NT": "America/St_Johns", "AT": "America/Halifax", "ET": "America/Toronto", "CT": "America/Winnipeg", "MT": "America/Edmonton", "PT": "America/Vancouver"}
# Month names, English and French, without accents.
MONTHS = {
    1: ("jan", "january", "janv", "janvier"), 2: ("feb", "february", "fev", "fevr", "fevrier"), 3: ("mar", "march", "mars"), 4: ("apr", "april", "avr", "avril"),
    5: ("may", "mai"), 6: ("jun", "june", "juin"), 7: ("jul", "july", "juil", "juillet"), 8: ("aug", "august", "aou", "aout"),
    9: ("sep", "sept", "september", "septembre"), 10: ("oct", "october", "octobre"), 11: ("nov", "november", "novembre"), 12: ("dec", "december", "decembre"),
}
# Units of relative dates in microseconds; a month is 30 days.
SECOND = 1_000_000
UNITS = {
    SECOND: ("s", "sec", "secs", "second", "seconds", "seconde", "secondes"),
    60 * SECOND: ("m", "min", "mins", "minute", "minutes"),
    3600 * SECOND: ("h", "hr", "hrs", "hour", "hours", "heure", "heures"),
    86400 * SECOND: ("d", "day", "days", "j", "jour", "jours"),
    7 * 86400 * SECOND: ("w", "wk", "wks", "week", "weeks", "sem", "semaine", "semaines"),
    30 * 86400 * SECOND: ("mo", "mos", "month", "months", "mois"),
}
ZONE = r"(?:\s*([+-]\d{2}:?\d{2}|Z|(?<=\s)[A-Za-z]{2,4}|(?<=\s)[A-Za-z_]+(?:/[A-Za-z_+-]+)+))?"
CLOCK = r"(?:(?:,?\s+|T|\s+at\s+|\s+à\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?" + ZONE + ")?"
LEAD = r"^(?:(?:posted|active|published|updated|publiée?)(?: on| le)?:?\s+)?(?:[a-z]{3,9}\.?,\s+)?"
WORD = r"([A-Za-zà-ÿ]{3,9})\.?"
#: (pattern, order of year, month, day among its first three groups); tried in this order.
NOTATIONS = (
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", "$1|$2|$3"),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", "$1|$2|$3"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3|$1|$2"),
    (r"(\d{1,2})-(\d{1,2})-(\d{4})", "$3|$2|$1"),
    (WORD + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", "$3|$1|$2"),
    (r"(\d{1,2})(?:er|st|nd|rd|th)?\s+" + WORD + r",?\s+(\d{4})", "$3|$2|$1"),
)


def _lookup(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _parts(text: Column) -> Column:
    """The nine parts joined by |, null where no notation fits."""
    branches = []
    for date, order in NOTATIONS:
        pattern = "(?i)" + LEAD + date + CLOCK + "$"
        branches.append(F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order + "|$4|$5|$6|$7|$8|$9")))
    return F.coalesce(F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3||||||")), *branches)


def _read_parts(rows: DataFrame, zone_default: str) -> DataFrame:
    """Adds the day, the time in the day and the zone of the nine parts in ``_mr_parts``."""
    p = F.split("_mr_parts", r"\|", -1)
    rows = rows.withColumns({f"_mr_{k}": p[i] for i, k in enumerate(("y", "mo", "d", "h", "mi", "s", "frac", "half", "zone"))})
    name = F.translate(F.lower("_mr_mo"), "éèêûùàâîôç", "eeeuuaaioc")
    month = F.coalesce(F.col("_mr_mo").try_cast("int"), F.try_element_at(_lookup({n: k for k, names in MONTHS.items() for n in names}), name))
    number = F.col("_mr_h").try_cast("int")
    half = F.upper(F.substring("_mr_half", 1, 1))
    rows = rows.withColumns(
        {
            "_mr_day": F.unix_date(F.try_to_date(F.concat_ws("-", F.lpad("_mr_y", 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad("_mr_d", 2, "0")), "yyyy-MM-dd")).cast("long") * (86400 * SECOND),
            "_mr_hour": F.when(half == "", number).when(number.between(1, 12), number % 12 + F.when(half == "P", 12).otherwise(0)),
            "_mr_min": F.col("_mr_mi").try_cast("int"),
            "_mr_sec": F.when(F.col("_mr_s") == "", 0).otherwise(F.col("_mr_s").try_cast("int")),
            "_mr_us": F.when(F.col("_mr_frac") == "", 0).otherwise(F.substring(F.rpad("_mr_frac", 6, "0"), 1, 6).try_cast("int")),
        }
    )
    zone = F.col("_mr_zone")
    minutes = F.when(zone.rlike(r"^[+-]\d"), F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (F.substring(zone, 2, 2).cast("int") * 60 + F.right(zone, F.lit(2)).cast("int"))).otherwise(F.try_element_at(_lookup(ZONE_MINUTES), F.upper(zone)))
    known = {z.upper(): z for z in sorted(zoneinfo.available_timezones()) if "/" in z} | ZONE_NAMES
    in_day = F.when((F.col("_mr_hour") < 24) & (F.col("_mr_min") < 60) & (F.col("_mr_sec") < 60), (F.col("_mr_hour") * 3600 + F.col("_mr_min") * 60 + F.col("_mr_sec")).cast("long") * SECOND + F.col("_mr_us"))
    return rows.withColumns(
        {
            "_mr_local": F.col("_mr_day") + in_day,
            "_mr_minutes": minutes.cast("long"),
            "_mr_region": F.try_element_at(_lookup(known), F.upper(F.when(zone == "", F.col(zone_default)).otherwise(zone))),
        }
    )


def _wall_micros() -> Column:
    """The instant of the parts read; null for impossible dates and unknown zones."""
    # both functions work on microseconds alone, whatever the time zone of the session
    at_wall = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_mr_local"), F.col("_mr_region")))
    return F.when(F.col("_mr_h") == "", F.col("_mr_day")).when(F.col("_mr_minutes").isNotNull(), F.col("_mr_local") - F.col("_mr_minutes") * (60 * SECOND)).when(F.col("_mr_region").isNotNull(), at_wall)


def _digits(text: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds since 1970, told apart by their length."""
    whole = text.try_cast("decimal(20,0)")
    fraction = F.substring(F.rpad(F.split_part(text, F.lit("."), F.lit(2)), 6, "0"), 1, 6).try_cast("long")
    return (
        F.when(text.rlike(r"^\d{9,10}$"), (whole * SECOND).cast("long"))
        .when(text.rlike(r"^\d{9,10}\.\d{1,9}$"), F.split_part(text, F.lit("."), F.lit(1)).try_cast("long") * SECOND + fraction)
        .when(text.rlike(r"^\d{12,13}$"), (whole * 1000).cast("long"))
        .when(text.rlike(r"^\d{15,16}$"), whole.cast("long"))
        .when(text.rlike(r"^\d{18,19}$"), F.floor(whole / 1000).cast("long"))
    )


def _relative(text: Column, seen_at: Column) -> Column:
    """Counted back from ``seen_at``; an open count such as 30+ days fixes no moment."""
    low = F.regexp_replace(F.lower(text), r"^(?:re)?(?:posted|active|published|updated|publiée?|actif|active)\s*:?\s+", "")
    day = F.floor(F.unix_micros(seen_at) / (86400 * SECOND)).cast("long") * (86400 * SECOND)
    pattern = r"^(?:il y a\s+)?(\d{1,4}|an?|one|une?)\s*([a-z]+)(?:\s+ago)?$"
    shaped = low.rlike(pattern) & (low.rlike(r"\sago$") | low.startswith("il y a"))
    count = F.coalesce(F.regexp_extract(low, pattern, 1).try_cast("long"), F.lit(1))
    unit = F.try_element_at(_lookup({n: micros for micros, names in UNITS.items() for n in names}), F.regexp_extract(low, pattern, 2))
    just = low.isin("today", "just posted", "just now", "aujourd'hui", "aujourd’hui") | F.lower(text).isin("just posted", "posted just now")
    return (
        F.when(just, day)
        .when(low.isin("yesterday", "hier"), day - 86400 * SECOND)
        .when(shaped, F.unix_micros(seen_at) - count * unit)
    )


def normalise_timestamps(rows: DataFrame, text: str, zone: str, seen_at: str, out: str = "instant_us") -> DataFrame:
    """``rows`` with ``out``: microseconds since 1970 in UTC of the date written in ``text``, null where it fixes no moment.

    Null or empty text, an unknown zone, an impossible date and an open count
    ("30+ days ago") give null. A null ``seen_at`` makes relative values null; a
    null or unknown ``zone`` makes zoneless wall times null. A column of the
    name ``out`` is replaced, all others stay as they are; names starting with
    ``_mr_`` are this operator's own.
    """
    kept = [c for c in rows.columns if c != out]
    tidy = F.trim(F.regexp_replace(F.col(text), r"[\s\u00a0\u202f]+", " "))
    staged = rows.withColumn("_mr_text", tidy)
    digits = F.col("_mr_text").rlike(r"^\d+(?:\.\d+)?$") & ~F.col("_mr_text").rlike(r"^\d{8}$")
    staged = staged.withColumn("_mr_parts", F.when(~digits, _parts(F.col("_mr_text"))))
    staged = _read_parts(staged, zone)
    value = F.when(F.col("_mr_parts").isNotNull(), _wall_micros()).when(digits, _digits(F.col("_mr_text"))).otherwise(_relative(F.col("_mr_text"), F.col(seen_at)))
    return staged.select(*[F.col(f"`{c}`") for c in kept], value.alias(out))


def posting_instants(postings: DataFrame) -> DataFrame:
    """(id, posted_us) for each id whose posted_date fixes a moment; deliveries of one id that differ keep the earliest."""
    needed = postings.select("id", "posted_date", "site_tz", "scraped_at").where(F.col("id").isNotNull())
    found = normalise_timestamps(needed, "posted_date", "site_tz", "scraped_at", "posted_us")
    # a filter before the aggregate would be pushed down to the scan with the whole expression in it
    return found.groupBy("id").agg(F.min("posted_us").alias("posted_us")).where(F.col("posted_us").isNotNull())
