"""Problem 4: signatures and pairs against brute force."""

import random
import re

import numpy as np

from millrace.llm import near_duplicates as nd
from millrace.llm.dartminhash import DartMinHash, mix

VOCABULARY = [f"word{k}" for k in range(400)]
SCHEMA = "job_id string, title string, description string, k int, b string, text string"


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    dart = DartMinHash(512)
    ids = mix(np.arange(300, dtype=np.uint64), 9)
    a = dart.signature(ids[:200])
    b = dart.signature(ids[40:240])
    assert abs((a == b).mean() - 160 / 240) < 0.08
    w1, w2 = rng.uniform(0.2, 3, 60), rng.uniform(0.2, 3, 60)
    s1, s2 = dart.signature(ids[:60], w1), dart.signature(ids[:60], w2)
    assert abs((s1 == s2).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.08
    assert (dart.signature(ids[:0]) == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert len(set(dart.signature(ids[:1]).tolist())) > 400


def brute(rows):
    sets = {}
    for job, title, description, *_ in rows:
        if job is not None:
            sets.setdefault(job, set(re.findall(r"[^\W_]+", f"{title or ''} {description or ''}".lower())))
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = rng.sample(VOCABULARY, rng.randint(30, 120))
        for m in range(rng.randint(1, 4)):
            words = [w if rng.random() > 0.03 * m else rng.choice(VOCABULARY) for w in base]
            rng.shuffle(words)
            rows.append((f"j{k:02}{m}", words[0].upper(), ", ".join(words[1:]), 0, "", ""))
    rows += [("copy1", "Same text", "of Copies", 0, "", ""), ("copy2", "same", "text of copies", 0, "", ""), ("copy3", "same", "text, of copies!", 0, "", ""), ("copy3", "same", "text, of copies!", 0, "", "")]
    rows += [("null1", None, None, 0, "", ""), ("null2", None, "", 0, "", ""), (None, "same", "text of copies", 0, "", ""), ("one1", "x", None, 0, "", ""), ("one2", None, "X", 0, "", ""), ("long1", "y " * 50_000, "z", 0, "", ""), ("long2", "z y", "", 0, "", "")]
    got = [(r.job_id_a, r.job_id_b) for r in nd.similar_pairs(spark.createDataFrame(rows, SCHEMA), "job_id", ["title", "description"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_groups_are_the_components_of_the_pairs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(25):
        base = rng.sample(VOCABULARY, 40)
        for m in range(rng.randint(1, 6)):
            if m and rng.random() < 0.3:
                base = [*base[4:], *rng.sample(VOCABULARY, 4)]
            rows.append((f"g{k:02}{m}", base[0], " ".join(base[1:]), 0, "", ""))
    group = {j: j for pair in brute(rows) for j in pair}
    moved = True
    while moved:
        moved = False
        for a, b in brute(rows):
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                moved = True
    got = nd.similar_groups(spark.createDataFrame(rows, SCHEMA), "job_id", ["title", "description"]).collect()
    assert {r.job_id: r.group_id for r in got} == group and len(got) == len(group)
    assert all(r.n_links >= 1 for r in got)


def test_empty(spark):
    assert nd.similar_groups(spark.createDataFrame([], SCHEMA), "job_id", ["title", "description"]).count() == 0
    assert nd.similar_pairs(spark.createDataFrame([], SCHEMA), "job_id", ["title", "description"]).count() == 0


def test_group_of_copies_is_folded(spark):
    rows = [(f"c{k:03}", "the same opening", "again and again", 0, "", "") for k in range(40)] + [("near", "the same opening", "again and again", 0, "", "")]
    assert nd.similar_pairs(spark.createDataFrame(rows, SCHEMA), "job_id", ["title", "description"]).count() == 41 * 40 // 2


def test_hardly_a_pair_at_the_threshold_shares_no_band():
    rng = np.random.default_rng(3)
    ids = mix(np.arange(900, dtype=np.uint64), 9)
    dart = DartMinHash(nd.COORDINATES)
    missed = 0
    for _ in range(1_000):
        words = rng.permutation(ids)[:80]
        a, b = words[:70], np.r_[words[:60], words[70:]]  # 60 of 80 words in common
        keys = nd.band_keys(np.stack([dart.signature(a), dart.signature(b)]))
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 2
    assert nd.COORDINATES >= nd.ROWS * nd.BANDS


def test_sketches_differ_in_no_more_bits_than_sets_in_words():
    rng = np.random.default_rng(4)
    ids = mix(np.arange(3_000, dtype=np.uint64), 9)
    for size in (1, 20, 150, 900):
        words = rng.permutation(ids)
        a, b = words[: size + 1], words[size // 4 : size + size // 4]
        differ = sum(int(x).bit_count() for x in (nd.sketch(a) ^ nd.sketch(b)).view(np.uint64))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
