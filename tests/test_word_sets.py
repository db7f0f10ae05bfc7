"""Sketches of word sets against the sets themselves."""

import random

import numpy as np
import pyarrow as pa

from millrace.functions import word_sets


def test_no_pair_that_shares_half_is_lost(monkeypatch):
    monkeypatch.setattr(word_sets, "TILE", 50)
    monkeypatch.setattr(word_sets, "SLICE", 30)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(1500)]
    made = [rng.choices(words[: rng.choice([8, 60, 1500])], k=rng.choice([0, 1, 3, 40, 120, 1400])) + [""] for _ in range(140)]
    made += [row[: len(row) * 2 // 3] + rng.choices(words, k=len(row) // 4) for row in made] + [None, []]
    bits, size = word_sets.sketches(pa.array(made, pa.list_(pa.string())))
    sets = [set(row or []) - {""} for row in made]
    assert size.tolist() == [len(s) for s in sets]
    got = {(i, j) for i, at in word_sets.may_share_half((bits, size), (bits, size)) for j in at.tolist()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a | b and 2 * len(a & b) >= len(a | b)}
    assert want <= got and len(want) > 300 and len(got) < len(sets) ** 2 / 2
    assert np.array_equal(word_sets.sketches(pa.array(made[5:], pa.list_(pa.string())))[0], bits[5:])


def test_spread_words_lose_no_pair_and_sort_out_unlike_sets():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(1000)]
    often = [0.5 * 0.995**k + 0.01 for k in range(1000)]
    sets = [{w for w, p in zip(words, often) if rng.random() < p} | {f"rare{n}"} for n in range(300)]
    sets += [{w for w in s if rng.random() < 0.8} | {f"new{n}"} for n, s in enumerate(sets)]
    own = word_sets.spread(dict(zip(words, often)))
    assert {b % (64 * word_sets.SHORT) for b in own.values()} == set(range(64 * word_sets.SHORT)) and max(own.values()) < 64 * word_sets.WIDTH
    rows = pa.array([sorted(s) for s in sets], pa.list_(pa.string()))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 2 * len(a & b) >= len(a | b)}
    assert len(want) > 1000
    left = []
    for bits, size in (word_sets.sketches(rows), word_sets.sketches(rows, own)):
        assert size.tolist() == [len(s) for s in sets]
        assert want <= {(i, j) for i, at in word_sets.may_share_half((bits, size), (bits, size)) for j in at.tolist()}
        short = word_sets._short(bits)
        apart = np.bitwise_count(short[:, None] ^ short[None]).sum(axis=2, dtype=np.int64)
        left.append(int((3 * apart <= size[:, None] + size[None]).sum()) - len(want))
    # a short sketch leaves few of the other pairs
    assert left[1] < 0.02 * len(sets) ** 2 and left[1] < 0.2 * left[0]
