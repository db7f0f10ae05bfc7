"""Problem 2: one surviving record of each group of duplicates.

Fields are unpivoted to long rows. Each value of a field gets a vote of
``2 ** (trust + age / half_life)``: the trust of its source times the decay of
its age. Votes are summed per normalised value, the value with most votes
wins (``max_by``) and the winners are pivoted back to one row a group.

Sums are kept in windows of ``2 ** 64`` so that no vote underflows, however
short the half-life. With one of a 64th of a microsecond (``LATEST``) every
microsecond is a window of its own, counted in whole numbers: the latest value
of the most trusted source outvotes everything else, which is the rule of
``p2_found``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

WINDOW_BITS = 64
#: Half-life with which a vote outweighs all that are a microsecond older, and the trust that outweighs any age.
LATEST, ANY_AGE = 0, 2**60


@dataclass(frozen=True)
class Field:
    """How a field is voted on.

    valid: which values count. normal: the form in which equal values agree.
    trust: log2 of the trust in the row's source, as an integer column.
    """

    name: str
    valid: Column
    normal: Column
    trust: Column


def group_roots(rows: DataFrame, key: str, link: str) -> DataFrame:
    """(parent, group_key) for every target of a link.

    Follows links by pointer doubling over the distinct targets only, so a
    target that a third of all rows point at is one row here. A target that is
    missing from ``rows`` is its own root; a cycle, which has no root, takes its
    smallest member.
    """
    targets = rows.where(F.col(link).isNotNull() & (F.col(link) != F.col(key))).groupBy(F.col(link).alias("parent")).agg(F.lit(1).alias("_one")).drop("_one")
    onward = rows.where(F.col(link).isNotNull() & (F.col(link) != F.col(key))).groupBy(F.col(key).alias("parent")).agg(F.min(link).alias("next"))
    hops = cut(targets.join(onward, "parent", "left").select("parent", F.coalesce("next", "parent").alias("next"), F.least("parent", F.coalesce("next", "parent")).alias("low"), F.col("next").isNull().alias("rooted")))
    while hops.where("NOT rooted").limit(1).count():
        ahead = hops.select(F.col("parent").alias("next"), F.col("next").alias("beyond"), F.col("low").alias("low2"), F.col("rooted").alias("rooted2"))
        moved = cut(hops.join(ahead, "next").select("parent", F.col("beyond").alias("next"), F.least("low", "low2").alias("low"), F.col("rooted2").alias("rooted"), (F.least("low", "low2") != F.col("low")).alias("lower"), (F.col("rooted2") != F.col("rooted")).alias("found")))
        hops = moved.drop("lower", "found")
        if moved.where("NOT rooted AND lower OR found").limit(1).count() == 0:
            # what is left runs in circles, and every circle knows its smallest member
            circle = hops.select(F.col("parent").alias("next"), F.col("low").alias("least"))
            hops = hops.join(circle, "next").select("parent", F.when(F.col("rooted"), F.col("next")).otherwise(F.col("least")).alias("next"))
            break
    return hops.select("parent", F.col("next").alias("group_key"))


def vote(rows: DataFrame, key: str, link: str, fields: list[Field], seen_at: str, half_life_ms: int) -> DataFrame:
    """(group_key, then <field>, <field>_key, <field>_votes for each field) for every group of two or more rows.

    Nulls and values that aren't valid get no vote; a field without a vote is
    null. Equal vote totals go to the larger normalised value, equal votes
    inside a value to the larger key. Repeated rows vote once. A row without a
    time votes as if it were of 1970. With half_life_ms LATEST, trust must be a
    multiple of 64.
    """
    latest = half_life_ms == LATEST
    parents = group_roots(rows, key, link)
    aged = F.coalesce(F.unix_micros(seen_at), F.lit(0)).cast("long")
    weigh = lambda trust: trust.cast("long") + aged * WINDOW_BITS if latest else trust.cast("double") + aged / F.lit(1000.0 * half_life_ms)
    parent = F.coalesce(F.col(link), F.col(key))
    ballots = F.array(
        *[
            F.when(
                f.valid,
                F.struct(F.lit(f.name).alias("field"), f.normal.cast("string").alias("normal"), F.col(f.name).cast("string").alias("value"), weigh(f.trust).alias("weight")),
            )
            for f in fields
        ],
        F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("normal"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long" if latest else "double").alias("weight")),
    )
    long = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), parent.alias("parent"), F.explode(F.array_compact(ballots)).alias("b")).select("_key", "parent", "b.*")
    # a vote also carries into the next window, scaled, so that a window holds all that counts beside its largest vote
    window = F.shiftright("weight", 6) if latest else F.floor(F.col("weight") / WINDOW_BITS)
    part = F.pow(F.lit(2.0), (F.col("weight") - window * WINDOW_BITS).cast("double"))
    spread = long.select(
        "_key", "parent", "field", "normal", "value", "weight",
        F.explode(F.array(F.struct(window.alias("window"), part.alias("part"), F.lit(True).alias("own")), F.struct((window + 1).alias("window"), (part * F.lit(2.0**-WINDOW_BITS)).alias("part"), F.lit(False).alias("own")))).alias("w"),
    )
    # by parent first: a hot group is combined before any shuffle, and only its few partial sums meet its root
    first = spread.where((F.col("field") != "") | F.col("w.own")).groupBy("parent", "field", "normal", F.col("w.window").alias("window")).agg(
        F.sum("w.part").alias("part"), F.max("w.own").alias("own"), F.count("*").alias("n"),
        F.max(F.when(F.col("w.own"), F.struct("weight", "_key", "value"))).alias("top"), F.min("_key").alias("k0"), F.max("_key").alias("k1"),
    )
    grouped = first.join(parents, "parent", "inner").groupBy("group_key", "field", "normal", "window").agg(F.sum("part").alias("part"), F.max("own").alias("own"), F.max("top").alias("top"), F.min("k0").alias("k0"), F.max("k1").alias("k1"))
    total = F.col("window") * WINDOW_BITS + F.log2("part")
    best = grouped.where("own").groupBy("group_key", "field").agg(F.max_by(F.struct("top.value", F.col("top._key").alias("key"), total.alias("votes")), F.struct("window", "part", "normal") if latest else F.struct(total, "normal")).alias("won"), F.min("k0").alias("k0"), F.max("k1").alias("k1"))
    wide = best.groupBy("group_key").agg(
        *[F.max(F.when(F.col("field") == f.name, F.col("won"))).alias(f.name) for f in fields],
        F.min(F.when(F.col("field") == "", F.col("k0"))).alias("k0"), F.max(F.when(F.col("field") == "", F.col("k1"))).alias("k1"),
    )
    out = [F.col("group_key")]
    for f in fields:
        out += [F.col(f"{f.name}.value").alias(f.name), F.col(f"{f.name}.key").alias(f"{f.name}_key"), F.col(f"{f.name}.votes").alias(f"{f.name}_votes")]
    return wide.where(F.col("k0") != F.col("k1")).select(*out)


# Pay that can be a year's pay, and the size buckets that say something.
PAY_RANGE = (15_000, 1_000_000)
BUCKETS = ("micro", "small", "medium", "large")


def job_fields(source_trust: int) -> list[Field]:
    """The voted fields of jobs; ``source_trust`` is log2 of the trust in pay that the site itself gave over pay read from text."""
    return [
        Field("salary_min_cad", F.col("salary_min_cad").between(*PAY_RANGE), F.col("salary_min_cad"), F.when(F.col("salary_source") == "source_field", source_trust).otherwise(0)),
        Field("company_size_bucket", F.col("company_size_bucket").isin(*BUCKETS), F.col("company_size_bucket"), F.lit(0)),
    ]


def survivors(jobs: DataFrame, half_life_ms: int, source_trust: int) -> DataFrame:
    """The surviving pay and size bucket of each group tied by duplicate_of."""
    needed = jobs.select("job_id", "duplicate_of", "salary_min_cad", "salary_source", "company_size_bucket", "fetched_at")
    return vote(needed, "job_id", "duplicate_of", job_fields(source_trust), "fetched_at", half_life_ms)
