"""Problem 6: what repeats an accepted posting, batch after batch."""

import random
from datetime import datetime, timezone

from millrace.llm import incremental as inc

T = datetime(2026, 1, 1, tzinfo=timezone.utc)
JOBS = "job_id string, url string, title_normalized string, company_normalized string, duplicate_of string, fetched_at timestamp, rank string, h long"
NEW = "arrival_id long, batch_no int, job_id string, url string, title_normalized string, company_normalized string, core string"
# a vocabulary needs rows: the stored postings name every word a few times
TITLES = ["senior data scientist fraud amber falcon", "junior data scientist fraud amber falcon", "senior data engineer pricing jade needle", "machine learning engineer speech lunar otter", "senior data scientist pricing jade otter"]


def stored(spark):
    rows = [(f"j{k}", f"https://www.site.example/jobs/view/{k}", t, "ulmcelsko forestry", None, T, "", 0) for k, t in enumerate(TITLES)]
    rows += [(f"f{k}{m}", f"https://www.site.example/jobs/fill/{k}{m}", t, f"filler{k}{m} media", None, T, "", 0) for k, t in enumerate(TITLES) for m in "abcd"]
    return spark.createDataFrame(rows, JOBS)


def answers(spark, rows):
    got = inc.check_batches(stored(spark), spark.createDataFrame([(*r, "") for r in rows], NEW)).collect()
    assert len({r.arrival_id for r in got}) == len(got)
    return {r.arrival_id: r.job_id for r in got}


def test_history_and_earlier_arrivals(spark):
    rows = [
        (1, 1, "n1", "http://SITE.example/jobs/view/0/?utm_source=alert#top", "something else entirely", "nobody"),
        (2, 1, "n2", "https://x.example/2", "urgent sr data scientist amber falcon fraud full time", "ulmcelsko forestry inc"),
        (3, 1, "n3", "https://x.example/3", "lead data scientist fraud amber falcon", "ulmcelsko forestry"),
        (4, 1, "n4", "https://x.example/4", "senior data scienist fraud ambre falcon", "ulmcelkso forestry canada"),
        (5, 1, "n5", "https://x.example/5", "ml engineer speech lunar otter", "ulmcelsko forestry"),
        (6, 1, "n6", "https://x.example/6", "senior data scientist fraud amber falcon", "another company"),
        (7, 2, "n7", "https://x.example/7", "falcon senior data scientist fraud amber", "another company ltd"),
        (8, 2, "n8", "https://x.example/3?trk=home", "junior data engineer pricing jade needle", "third company"),
        (9, 3, "n9", "https://x.example/9", "junior data engineer pricing jade needle", "third company"),
        (10, 3, "n10", "https://x.example/10", "jr data engineer pricing jade needle", "third company"),
        (11, 3, "n11", None, None, None),
        (12, 3, "n12", "", "", ""),
        (12, 3, "n12", "", "", ""),
        (13, 3, "n13", None, None, None),
    ]
    # 3 is another level and so is accepted; 8 repeats its page and is refused, so 9 is new and 10 repeats 9
    assert answers(spark, rows) == {1: "j0", 2: "j0", 4: "j0", 5: "j3", 7: "n6", 8: "n3", 10: "n9"}


def test_empty(spark):
    assert answers(spark, []) == {}
    none = inc.check_batches(stored(spark).limit(0), spark.createDataFrame([(1, 1, "n1", "u", "a b", "c", ""), (2, 1, "n2", "u", "x", "y", "")], NEW)).collect()
    assert [(r.arrival_id, r.job_id) for r in none] == [(2, "n1")]


def test_hot_group(spark):
    rows = [(k, 1 + k // 200, f"n{k}", f"https://x.example/{k}", "senior data engineer pricing jade otter", "hot company") for k in range(400)]
    assert answers(spark, rows) == {k: "n0" for k in range(1, 400)}


def test_pages(spark):
    urls = ["https://www.Site.example/Jobs/1/", "http://site.example/Jobs/1?utm_medium=x&trk=2", "https://site.example/Jobs/1?jk=5", "https://site.example/Jobs/1?b=1&jk=5#x", "", None]
    got = [r.p for r in spark.createDataFrame([(u,) for u in urls], "u string").select(inc.canonical_page(inc.F.col("u")).alias("p")).collect()]
    assert got == ["site.example/Jobs/1", "site.example/Jobs/1", "site.example/Jobs/1?jk=5", "site.example/Jobs/1?b=1&jk=5", None, None]


def test_a_slip_in_a_short_company(spark):
    slips = [("ibm", "ibn"), ("ebay", "ebya"), ("kpmg", "kpg"), ("telus", "tellus"), ("rogers", "rodgers"), ("shopify", "shoqify"), ("stripe", "srtipe"), ("deloitte", "deloite"), ("accenture", "accemture"), ("microsoft", "nicrosoft"), ("ulmcelskoforestry", "ulmxelskofoxestry"), ("bombardierrail", "xbombardierraiz")]
    title = "senior data scientist fraud amber falcon"
    jobs = spark.createDataFrame([(f"j{k}", None, title, a, None, T, "", 0) for k, (a, _) in enumerate(slips)] + [(f"f{k}", None, t, f"filler{k} media", None, T, "", 0) for k, t in enumerate(TITLES)], JOBS)
    rows = [(k, 1, f"n{k}", None, title, b, "") for k, (_, b) in enumerate(slips)] + [(98, 1, "n98", None, title, "hp", ""), (99, 1, "n99", None, title, "hq", "")]
    got = {r.arrival_id: r.job_id for r in inc.check_batches(jobs, spark.createDataFrame(rows, NEW)).collect()}
    assert got == {k: f"j{k}" for k in range(len(slips))}
    # and inside a batch
    rows = [(2 * k + m, 1, f"n{2 * k + m}", None, title, name, "") for k, pair in enumerate(slips) for m, name in enumerate(pair)]
    got = {r.arrival_id: r.job_id for r in inc.check_batches(jobs.where("job_id like 'f%'"), spark.createDataFrame(rows, NEW)).collect()}
    assert got == {2 * k + 1: f"n{2 * k}" for k in range(len(slips))}


def test_parts_meet_whatever_two_edits_do(spark):
    rng = random.Random(2)
    rows = []
    for size in list(range(3, 13)) * 60:
        a = [rng.choice("abcdefgh") for _ in range(size)]
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b) + 1)
            what = rng.randrange(3)
            b[at : at + (what > 0)] = [rng.choice("abcdefgh")] if what < 2 else []
        if len(b) >= 3:
            rows.append(("t", "".join(a), "".join(b)))
    f = inc.F
    seen = spark.createDataFrame(rows, "t string, a string, b string").where("levenshtein(a, b) <= 2")
    missed = seen.where(~f.arrays_overlap(inc.asked_parts(f.col("t"), f.col("a")), inc.stored_parts(f.col("t"), f.col("b"))))
    assert seen.count() > 500 and missed.collect() == []


def test_a_history_outlives_a_call_and_is_not_moved(spark):
    name = f"kept_{random.randrange(1 << 40)}"
    made = inc.History(spark, name, buckets=4).build(stored(spark))
    first = [(1, 1, "n1", "https://x.example/1", "senior data scientist fraud amber falcon", "first company", "")]
    assert inc.check_and_append(made, spark.createDataFrame(first, NEW)).collect() == []
    spark.sql(f"DROP TABLE {name}")  # as in a later session, which knows no table but finds its files
    again = inc.History(spark, name, buckets=4)
    later = [(2, 2, "n2", "https://x.example/2", "sr data scientist amber falcon fraud", "frist company", ""), (3, 2, "n3", "https://www.site.example/jobs/view/1", "other", "x", "")]
    assert {r.arrival_id: r.job_id for r in inc.check_and_append(again, spark.createDataFrame(later, NEW)).collect()} == {2: "n1", 3: "j1"}
    # too large to be broadcast: the new rows are moved to the buckets, the table stays
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        batch = inc.read_keys(spark.createDataFrame(later, NEW), ["arrival_id", "job_id"], again.vocabulary())
        plan = again.met(batch)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    lines = plan.split("\n")
    scan = next(k for k, line in enumerate(lines) if f"{name}[" in line)
    side = max(k for k in range(scan) if "Sort [h#" in lines[k])
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in lines[side:scan]), plan
    again.drop()


def test_a_slip_in_a_rare_word_and_a_very_long_title(spark):
    rows = [
        (1, 1, "n1", None, "senior data scientist zanzibar amber falcon", "ulmcelsko forestry", ""),
        (2, 1, "n2", None, "senior data scientist zanzbard amber falcon", "first company", ""),
    ]
    more = spark.createDataFrame([("r1", None, "senior data scientist zanzibard amber falcon", "first company", None, T, "", 0), ("r2", None, "senior data scientist zanzibar amber falcon", "second company", None, T, "", 0), ("r3", None, " ".join(f"word{k}" for k in range(3_000)), "third company", None, T, "", 0)], JOBS)
    rows += [(3, 1, "n3", None, " ".join(f"word{k}" for k in reversed(range(3_000))), "third company", ""), (4, 1, "n4", None, "senior data scientist tanzania amber falcon", "first company", ""), (5, 1, "n5", None, "senior data scientist zanzibar amber falcon", "first company", "")]
    got = {r.arrival_id: r.job_id for r in inc.check_batches(stored(spark).unionByName(more), spark.createDataFrame(rows, NEW)).collect()}
    # 5 is a word the history knows from another posting, so it isn't taken for a slip
    assert got == {2: "r1", 3: "r3"}
