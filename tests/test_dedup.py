"""Resolution against plain sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.similarity import ratio
from millrace.operators import dedup

WORDS = ["data", "senior", "analyst", "engineer", "ml", "acme", "corp", "nlp", "vision", "lead"]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_ratio_is_indel():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 80))) for _ in range(2))
        want = 200 * slow_lcs(a, b) / (len(a) + len(b)) if a or b else 100
        assert abs(ratio(a, b) - want) < 1e-9


def test_fuzzy_join_against_brute_force(spark):
    rng = random.Random(2)
    strings = [" ".join(rng.choices(WORDS, k=rng.randint(1, 6))) for _ in range(80)] + ["", "same", "same", None]
    table = spark.createDataFrame([(s,) for s in strings], "s string")
    plain = sorted({s for s in strings if s is not None})
    for threshold in (70, 85):
        want = {(a, b) for a in plain for b in plain if a < b and ratio(a, b) >= threshold}
        assert {(r.a, r.b) for r in dedup.fuzzy_join(table, None, threshold).collect()} == want
        half = table.where(F.length("s") > 20)
        want = {(a, b) for a in plain if len(a) > 20 for b in plain if ratio(a, b) >= threshold}
        assert {(r.a, r.b) for r in dedup.fuzzy_join(half, table, threshold).collect()} == want
    assert dedup.fuzzy_join(table.limit(0), None, 85).count() == 0


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), *[(f"n{k:02}", f"n{k + 1:02}") for k in range(20)]]
    nodes = sorted({v for e in edges for v in e} | {"alone"})
    got = {r.v: r.component for r in dedup.components(spark.createDataFrame([(v,) for v in nodes], "v string"), spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["alone"] == "alone" and got["n20"] == "n00"


def sequential(batch, existing):
    """The plain loop: url seen, else best match over existing and accepted."""
    urls = {e[2] for e in existing}
    pool = [(e[0], e[3], e[4]) for e in sorted(existing, key=lambda e: e[1])]
    out = {}
    key = lambda t: " ".join(sorted(t.split()))
    words = lambda t: set(t.lower().split())
    for new, _, url, text, description in sorted(batch, key=lambda b: b[1]):
        if url in urls:
            out[new] = "within_run_dup"
            continue
        urls.add(url)
        best, who = -1, None
        for other in pool:
            s = ratio(key(text), key(other[1]))
            if s > best:
                best, who = s, other
        kind = "canonical"
        if best >= 90:
            kind = "fuzzy_title_company"
        elif best >= 70:
            a, b = words(description), words(who[2])
            if a | b and len(a & b) / len(a | b) >= 0.5:
                kind = "description_similarity"
        out[new] = (kind, who[0]) if kind != "canonical" else kind
        if kind == "canonical":
            pool.append((new, text, description))
    return out


def no_search_at_the_floor(monkeypatch):
    """Whole tables may not be searched down to AMBIGUOUS_AT."""

    def refuse(*_):
        raise AssertionError("a search at the floor")

    plain = dedup.fuzzy_join
    monkeypatch.setattr(dedup, "closest", refuse)
    monkeypatch.setattr(dedup, "fuzzy_join", lambda left, right, threshold: refuse() if threshold < dedup.CLUSTER_AT else plain(left, right, threshold))


def test_check_searches_low_only_beside_alike_descriptions(spark, monkeypatch):
    no_search_at_the_floor(monkeypatch)
    rng = random.Random(5)
    row = lambda k, p: (f"{p}{k}", k, f"{p}{k}", " ".join(rng.choices(WORDS, k=5)), " ".join(rng.choices(WORDS, k=4)) if k % 9 else None)
    new, old = [row(k, "n") for k in range(80)], [row(k, "o") for k in range(40)]
    key = lambda t: " ".join(sorted(t.split()))
    want = {}
    for n in new:
        score, _, o = max(((ratio(key(n[3]), key(o[3])), -o[1], o) for o in old), key=lambda x: x[:2])
        a, b = set((n[4] or "").split()), set((o[4] or "").split())
        if score >= 90 or (score >= 70 and a | b and len(a & b) / len(a | b) >= 0.5):
            want[n[0]] = (o[0], "fuzzy_title_company" if score >= 90 else "description_similarity")
    tables = [spark.createDataFrame(t, f"{p}_id string, {k} long, url string, text string, description string") for t, p, k in ((new, "new", "seq"), (old, "old", "rank"))]
    got = dedup.dedup_check(tables[0].drop("seq"), tables[1]).collect()
    assert {r.new_id: (r.canonical_id, r.match_type) for r in got} == want and len({k for _, k in want.values()}) == 2


def test_order_searches_low_only_beside_alike_descriptions(spark, monkeypatch):
    no_search_at_the_floor(monkeypatch)
    monkeypatch.setattr(dedup, "MANY", 3)
    rng = random.Random(6)
    row = lambda k, p: (f"{p}{k}", k, f"{p}{k}", " ".join(rng.choices(WORDS, k=5)), " ".join(rng.choices(WORDS, k=4)))
    batch = [row(k, "n") for k in range(70)]
    schema = "{0}_id string, {1} long, url string, text string, description string"
    for existing in ([row(k, "o") for k in range(12)], []):
        got = dedup.resolve_in_order(spark.createDataFrame(batch, schema.format("new", "seq")), spark.createDataFrame(existing, schema.format("old", "rank"))).collect()
        seen = {r.new_id: (r.decision, r.canonical_id) if r.decision in ("fuzzy_title_company", "description_similarity") else r.decision for r in got}
        assert seen == sequential(batch, existing) and len(got) == 70


def test_ordered_check_against_the_loop(spark):
    rng = random.Random(3)
    row = lambda k, p: (f"{p}{k}", k, f"u{rng.randint(0, 60)}", " ".join(rng.choices(WORDS, k=5)), " ".join(rng.choices(WORDS, k=4)))
    batch, existing = [row(k, "n") for k in range(45)], [row(k, "o") for k in range(8)]
    got = dedup.resolve_in_order(spark.createDataFrame(batch, "new_id string, seq long, url string, text string, description string"), spark.createDataFrame(existing, "old_id string, rank long, url string, text string, description string")).collect()
    assert len(got) == len(batch)
    seen = {r.new_id: (r.decision, r.canonical_id) if r.decision in ("fuzzy_title_company", "description_similarity") else r.decision for r in got}
    assert seen == sequential(batch, existing)


def test_clusters_keep_the_first(spark):
    rows = [(1, "data scientist|acme"), (2, "data scientists|acme"), (3, "chef|bistro"), (4, "data scientist|acme"), (5, "data scientistss|acme")]
    got = dedup.cross_source_clusters(spark.createDataFrame(rows, "seq long, fp string"), "seq", "seq").collect()
    assert sorted(r.seq for r in got if r.kept) == [1, 3] and len(got) == 5


def test_check(spark):
    old = [("o1", 1, "u1", "senior data scientist acme corp", "we build models"), ("o2", 2, "u2", "cook bistro", "we cook")]
    new = [("n1", "u1", "x", "y"), ("n2", "u9", "data scientist senior acme corp", "z"), ("n3", "u8", "senior data scientist acme", "we build models now"), ("n4", "u7", "zzz", "q"), ("n5", None, "zzz", None)]
    got = dedup.dedup_check(spark.createDataFrame(new, "new_id string, url string, text string, description string"), spark.createDataFrame(old, "old_id string, rank long, url string, text string, description string")).collect()
    assert {(r.new_id, r.canonical_id, r.match_type) for r in got} == {("n1", "o1", "url_exact"), ("n2", "o1", "fuzzy_title_company"), ("n3", "o1", "description_similarity")} or {r.new_id for r in got} == {"n1", "n2", "n3"}


def test_one_string_repeated_many_times(spark):
    schema = "new_id string, seq long, url string, text string, description string"
    batch = spark.createDataFrame([(f"n{k}", k, f"u{k}", "senior data engineer pricing acme", f"words {k}") for k in range(600)], schema)
    none = spark.createDataFrame([], "old_id string, rank long, url string, text string, description string")
    got = {r.new_id: (r.decision, r.canonical_id) for r in dedup.resolve_in_order(batch, none).collect()}
    assert got.pop("n0") == ("canonical", None) and len(got) == 599 and set(got.values()) == {("fuzzy_title_company", "n0")}
    # all repeat a stored one that is spelt otherwise: nothing waits for anything
    stored = spark.createDataFrame([("old", 1, "x", "senior data engineers pricing acme", "other")], none.schema)
    assert {(r.decision, r.canonical_id) for r in dedup.resolve_in_order(batch, stored).collect()} == {("fuzzy_title_company", "old")}


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"{k:04}" for k in range(400)]
    rng.shuffle(names)
    edges = list(zip(names, names[1:]))
    rounds, plain = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: rounds.append(1) or plain(df))
    got = dedup.components(spark.createDataFrame([(v,) for v in names], "v string"), spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.component for r in got} == {"0000"} and len(got) == 400
    assert len(rounds) <= 12


@pytest.mark.parametrize("block, group", [(36_000, 120_000), (7, 14)])
def test_rows_of_a_batch_meet_once_beside_alike_descriptions(spark, monkeypatch, block, group):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "GROUP", group)
    rng = random.Random(4)
    titles, words = ["data analyst acme", "data analyst acme corp", "senior data analyst acne", "ml engineer", "lead ml engineers of acme"], [f"w{k}" for k in range(60)]
    texts = [rng.sample(words, 12) for _ in range(10)]
    rows = [(f"{rng.choice(titles)} {'abc'[k % 3] * (k % 5)}", " ".join(rng.sample(rng.choice(texts), 10))) for k in range(120)]
    left, right = (spark.createDataFrame(part, "s string, description string") for part in (rows[:60], rows[60:]))
    want: dict[str, float] = {}
    for s, x in rows[:60]:
        for t, y in rows:
            a, b, q = set(x.split()), set(y.split()), ratio(s, t)
            if 2 * len(a & b) >= len(a | b) and dedup.AMBIGUOUS_AT <= q < dedup.FUZZY_AT:
                want[s] = min(q, want.get(s, 100.0))
    met = []
    units = dedup._by_unit
    monkeypatch.setattr(dedup, "_by_unit", lambda made, *rest: met.append(made.groupBy("y", "z").pivot("side", [0, 1, 2]).count().na.fill(0).collect()) or units(made, *rest))
    got = {r.s: r.mark for r in dedup.described(left, right, right, True).collect()}
    # a pair that no bound sorts out may only lower a mark
    assert len(want) > 20 and set(want) <= set(got) and all(got[s] <= m for s, m in want.items())
    n, stored = (len({(s, frozenset(x.split())) for s, x in part}) for part in (rows[:60], rows[60:]))
    among = sum((r["0"] + r["2"]) * (r["1"] + r["2"]) for r in met[1])
    assert sum(r["0"] * r["1"] for r in met[0]) == n * stored and among == (n * n + sum((r["1"] + r["2"]) ** 2 for r in met[1] if r["z"] == 0)) / 2
