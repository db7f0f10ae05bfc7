"""Problem 2: votes, groups, ties and odd links."""

from collections import defaultdict
from datetime import datetime, timedelta, timezone
import random

from millrace.llm import survivors

SCHEMA = "job_id string, duplicate_of string, salary_min_cad int, salary_source string, company_size_bucket string, fetched_at timestamp, parent string, field string"
START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def at(hours):
    return START + timedelta(hours=hours)


def found(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    won = survivors.survivors(table, **({"half_life_ms": survivors.LATEST, "source_trust": survivors.ANY_AGE} | kw)).collect()
    return {r.group_key: (r.salary_min_cad_key, r.company_size_bucket_key) for r in won}


def test_rules(spark):
    rows = [
        ("a", None, 50000, "regex", "small", at(1)), ("b", "a", 60000, "source_field", "unknown", at(0)), ("c", "b", 70000, "regex", None, at(9)), ("d", "c", 5, "source_field", "large", at(10)),
        ("e", None, None, None, None, None), ("f", "e", None, None, "", None), ("alone", None, 50000, "regex", "small", at(1)),
        ("g", "gone", 20000, None, "micro", at(1)), ("h", "gone", 30000, None, "micro", at(2)),
        ("x", "y", 20000, None, None, at(1)), ("y", "x", 30000, None, None, at(1)),
    ]
    got = found(spark, rows)
    assert got["a"] == ("b", "d")
    assert got["e"] == (None, None)
    assert "alone" not in got
    # members of a missing record still stand together; a cycle is named after its smallest member; ties go to the larger value
    assert got["gone"] == ("h", "h") and got["x"] == ("y", None)


def test_repeats_nulls_and_empty(spark):
    assert found(spark, [("a", None, 50000, "regex", "small", at(1))] * 3) == {}
    assert found(spark, []) == {}
    assert found(spark, [(None, None, 50000, "regex", "small", at(1)), ("a", "a", 50000, "regex", "small", at(1))]) == {}


def test_long_chain(spark):
    rows = [("r000", None, 20000, None, "small", at(0))] + [(f"r{k:03}", f"r{k - 1:03}", 20000 + k, None, "small", at(k)) for k in range(1, 70)]
    assert found(spark, rows) == {"r000": ("r069", "r069")}


def test_votes_against_plain_sums(spark):
    rng = random.Random(4)
    rows, half = [], 30 * 86400
    for g in range(15):
        rows.append((f"g{g}", None, rng.choice([20000, 30000, 40000]), rng.choice(["source_field", "regex"]), "small", at(rng.randint(0, 9000))))
        rows += [(f"g{g}m{k}", f"g{g}", rng.choice([20000, 30000, 40000]), rng.choice(["source_field", "regex"]), "small", at(rng.randint(0, 9000))) for k in range(6)]
    table = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = {r.group_key: int(r.salary_min_cad) for r in survivors.survivors(table, half_life_ms=half * 1000, source_trust=2).collect()}
    votes = defaultdict(lambda: defaultdict(float))
    for job, up, pay, source, _, seen in rows:
        votes[up or job][pay] += 2.0 ** ((2 if source == "source_field" else 0) + (seen - START).total_seconds() / half)
    assert got == {g: max(v, key=v.get) for g, v in votes.items()}


def test_hot_group(spark):
    rows = [("hub", None, 20000, None, "small", at(0))] + [(f"m{k:05}", "hub", 20000 + k % 7, None, "large", at(k)) for k in range(3000)]
    assert found(spark, rows) == {"hub": ("m02999", "m02999")}


def test_a_microsecond_decides_however_many_agree(spark):
    t = at(1)
    rows = [("a", None, 50000, "regex", "small", t), ("b", "a", 50000, "regex", "small", t), ("c", "a", 40000, "regex", "micro", t + timedelta(microseconds=1))]
    rows += [(f"d{k}", "a", 50000, "regex", "small", t) for k in range(200)]
    assert found(spark, rows)["a"] == ("c", "c")
    # in the same microsecond the value that more rows hold wins
    rows = [("a", None, 50000, "regex", "small", t), ("b", "a", 50000, "regex", "small", t), ("c", "a", 60000, "regex", "micro", t)]
    assert found(spark, rows)["a"] == ("b", "b")
    # an early value of the site itself goes before a late one read from text
    rows = [("a", None, 50000, "source_field", "small", datetime(1971, 1, 1, tzinfo=timezone.utc)), ("b", "a", 60000, "regex", None, datetime(2200, 1, 1, tzinfo=timezone.utc))]
    assert found(spark, rows)["a"] == ("a", "a")
