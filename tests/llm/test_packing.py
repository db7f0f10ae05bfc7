"""Problem 7: plans and packings."""

import random
from collections import Counter

import pytest

from millrace.llm import packing


def load(plan, histogram):
    bins = Counter()
    for size, n in histogram.items():
        for rank in range(n):
            bins[plan.place(size, rank)] += size
    return bins


@pytest.mark.parametrize("seed", range(25))
def test_plans_fit_and_are_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 64, 100])
    histogram = dict(Counter(max(1, min(capacity, int(rng.expovariate(1 / (capacity / 3))))) for _ in range(rng.choice([1, 5, 60, 400]))))
    plan = packing.make_plan(histogram, capacity)
    bins = load(plan, histogram)
    assert set(bins) == set(range(plan.bins)) and max(bins.values()) <= capacity
    assert plan.bins <= 1.25 * sum(s * n for s, n in histogram.items()) / capacity + 1 + sum(n for s, n in histogram.items() if 2 * s > capacity)
    assert sum(n for s, n in histogram.items()) >= plan.bins


def test_large_pieces_pair():
    plan = packing.make_plan({6: 2, 4: 2, 5: 3}, 10)
    assert plan.bins == 4 and max(load(plan, {6: 2, 4: 2, 5: 3}).values()) == 10


def test_no_pieces():
    assert packing.make_plan({}, 10).bins == 0


SCHEMA = "doc_id long, text string, size int, rank int, part int"


def test_documents(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["data", "model", "plan", "über", "42,"]) for _ in range(rng.randint(1, 90))) for _ in range(200)] + ["", None, "same text"] + ["same text"] * 20 + ["word " * 5000]
    docs = spark.createDataFrame([(k, t, 0, 0, 0) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    sizes = spark.createDataFrame([(1, 64), (2, 300)], "pack_id long, capacity_tokens int")
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    rows = packing.pack(docs, sizes).collect()
    for pack, capacity in ((1, 64), (2, 300)):
        mine = [r for r in rows if r.pack_id == pack]
        bins = Counter()
        covered = Counter()
        for r in mine:
            bins[r.bin_id] += r.n_tokens
            covered[r.doc_id] += r.n_tokens
            assert r.first_token == r.piece * capacity
        assert max(bins.values()) <= capacity and set(bins) == set(range(len(bins)))
        assert covered == {d: n for d, n in counts.items() if n}
        assert all(counts[r.doc_id] > capacity for r in mine if r.piece > 0)
        assert len(bins) <= 1.06 * sum(counts.values()) / capacity + 2
    fill = {r.pack_id: r for r in packing.fill(packing.pack(docs, sizes), sizes).collect()}
    assert fill[1].n_bins >= fill[1].least_bins and fill[1].largest_bin <= 64


def test_empty_and_refused(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack(docs, spark.createDataFrame([(1, 64)], "pack_id long, capacity_tokens int")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, spark.createDataFrame([(1, 0)], "pack_id long, capacity_tokens int"))


def test_long_text_counts_like_a_short_one(spark, monkeypatch):
    text = "one two  three, four\n\nfive   " * 40
    docs = spark.createDataFrame([(1, text, 0, 0, 0)], SCHEMA)
    whole = packing.token_counts(docs).first().n_tokens
    assert whole > 200
