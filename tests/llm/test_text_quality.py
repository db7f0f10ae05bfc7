"""Problem 9: statistics, mixture and verdict."""

import random

import numpy as np

from millrace.llm import text_quality as tq

SCHEMA = "doc_id long, text string, kind string, log_words double"
PROSE = "The team meets on Mondays to plan the week, and everyone brings one question. Nobody is asked to stay late, although some do when a release is near."
NAV = "Home\nLogin\nHelp\nShare\nPrint\nCookies\nSign up\nAlerts\nPrivacy"


def test_sentences():
    assert tq.sentence_chars(PROSE) > 0.95 * len(PROSE)
    assert tq.sentence_chars(PROSE.replace(" ", "\n", 6).replace("plan the", "plan\nthe")) > 0.5 * len(PROSE)
    assert tq.sentence_chars("- You will help the analysts to find errors in the data.\n- You will write short notes that others can follow.") > 90
    for junk in (NAV, "https://a.example/b/1?c=2\n" * 9, "a;b;c;1\nd;e;f;2\n" * 8, "DATA ENGINEER REMOTE " * 20 + "!!!", "", "???", "best jobs near me apply salary best data jobs. " * 5):
        assert tq.sentence_chars(junk) < 0.3 * max(1, len(junk)), junk
    assert len(tq.statistics("")) == len(tq.STATISTICS) and all(np.isfinite(tq.statistics("")))


def documents(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        kind = k % 5
        text = " ".join([PROSE] * rng.randint(1, 4)) if kind < 3 else NAV * rng.randint(1, 3) if kind == 3 else "role,town,from,to\n" + "Analyst,Guelph,60000,90000\n" * rng.randint(4, 20)
        rows.append((k, text, "x", 1.0))
    return rows


def test_verdicts(spark):
    rows = documents(spark) + [(900, None, "x", 1.0), (901, "", "x", 1.0), (902, PROSE * 3000, "x", 1.0), (903, NAV, "x", 1.0), (903, NAV, "x", 1.0)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(r.doc_id for r in tq.not_prose(table).collect())
    want = sorted({k for k, t, *_ in rows if tq.sentence_chars(t or "") < 0.5 * max(1, len(t or ""))})
    assert got == want
    kinds = {r.doc_id: r.kind for r in tq.classify(table).collect()}
    assert len(kinds) == 304 and kinds[900] == "junk" and kinds[902] == "prose" and set(kinds.values()) <= set(tq.KINDS)


def test_fit_settles_above_its_seeds(spark):
    stats = tq.document_statistics(spark.createDataFrame(documents(spark), SCHEMA)).cache()
    raw = np.array([tuple(r)[1:] for r in stats.collect()])
    start, end = tq.seeded(raw[:40], raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-6)), tq.fit(stats)
    share, log = end.responsibilities(raw)
    assert log >= start.responsibilities(raw)[1]
    assert abs(end.weights.sum() - 1) < 1e-9 and np.allclose(share.sum(axis=1), 1)
    # another round changes next to nothing
    again = end.next(end.sums(raw))
    assert abs(again.responsibilities(raw)[1] - log) < 1e-3 * abs(log)


def test_the_mixture_decides(spark, monkeypatch):
    table = spark.createDataFrame(documents(spark), SCHEMA)
    got = tq.classify(table).collect()
    clear = [r for r in got if max(r.p_prose, r.p_other) >= tq.SURE]
    assert len(clear) > 0.9 * len(got)
    found = {r.doc_id for r in tq.not_prose(table).collect()}
    assert all((r.doc_id in found) == (r.p_other >= tq.SURE) for r in clear)
    # with its clear components exchanged the verdicts turn, whatever the sentences say
    monkeypatch.setattr(tq.Mixture, "clear", lambda self, kinds: ([k for k, x in enumerate(kinds) if x != "prose"], [k for k, x in enumerate(kinds) if x == "prose"]))
    turned = {r.doc_id for r in tq.not_prose(table).collect()}
    assert all((r.doc_id in turned) != (r.doc_id in found) for r in clear)


def test_empty(spark):
    assert tq.classify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tq.not_prose(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tq.classify(spark.createDataFrame([(1, PROSE, "", 0.0)], SCHEMA)).count() == 1
