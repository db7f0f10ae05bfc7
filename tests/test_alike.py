"""Pairs of alike strings against brute force."""

import random

import numpy as np
import pytest

from millrace.functions import alike
from millrace.functions.similarity import ratio
from millrace.operators import dedup

ODD = ["", " ", "|", "x" * 300, "senior|acme", "été été", "a" * 64, "a" * 65, "a" * 128 + "b"]


def titles(rng, n, words):
    made = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(n)]
    slips = [s[: (p := rng.randrange(len(s)))] + rng.choice("aqz |") + s[p + 1 :] for s in made]
    return sorted({*made, *slips, *ODD})


@pytest.mark.parametrize("both_ways", [False, True])
@pytest.mark.parametrize("threshold", [0, 50, 70, 85, 90, 100])
def test_pairs_and_closest(monkeypatch, threshold, both_ways):
    monkeypatch.setattr(alike, "OFTEN", (3, 3))
    rng = random.Random(threshold)
    words = ["data", "senior", "analyst", "engineer", "ml", "acme", "corp", "nlp", "vision", "lead", "y" * 40]
    a, b = titles(rng, 60, words), titles(rng, 70, words)
    score = {(p, q): ratio(p, q) for p in a for q in b}
    got = list(alike.Matcher(a, b, both_ways).pairs(threshold))
    assert sorted(got) == sorted((p, q, s) for (p, q), s in score.items() if s >= threshold)
    most = {p: max(score[p, q] for q in b) for p in a}
    matcher = alike.Matcher(a, b, both_ways)
    marks = dict(matcher.marks(threshold))
    assert all(threshold <= s <= most[p] for p, s in marks.items())
    got = list(matcher.best({p: marks.get(p, float(threshold)) for p in a}))
    assert sorted(got) == sorted((p, q, s) for (p, q), s in score.items() if s == most[p] >= threshold)


def test_few_pairs_are_scored(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 10))) for _ in range(80)]
    made = [" ".join(rng.choices(words, k=8)) for _ in range(2000)]
    scored, plain = [], alike._subsequences
    monkeypatch.setattr(alike, "_subsequences", lambda a, b, i, j, n: scored.append(len(i)) or plain(a, b, i, j, n))
    list(alike.Matcher(made[:1000], made[1000:], False).pairs(85))
    assert sum(scored) < 10_000


@pytest.mark.parametrize("block, group", [(40, 100), (7, 14)])
def test_every_block_meets_every_block(spark, monkeypatch, block, group):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "GROUP", group)
    rng = random.Random(8)
    strings = titles(rng, 45, ["data", "senior", "analyst", "engineer", "ml"])
    table = spark.createDataFrame([(s,) for s in strings], "s string")
    want = {(p, q) for p in strings for q in strings if p < q and ratio(p, q) >= 85}
    got = [(r.a, r.b) for r in dedup.fuzzy_join(table, None, 85).collect()]
    assert len(got) == len(want) and set(got) == want
    half = strings[::2]
    most = {p: max(ratio(p, q) for q in half) for p in strings}
    want = {(p, q) for p in strings for q in half if ratio(p, q) == most[p] >= 70}
    assert {(r.a, r.b) for r in dedup.closest(table, table.where(table.s.isin(half)), 70).collect()} == want


def test_distances_of_pieces_lose_nothing_and_are_found_once_a_pair_of_words(monkeypatch):
    def to_substring(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            before, row[0] = row[:], i
            for j, d in enumerate(t, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] if c == d else 99)
        return min(row)

    rng = random.Random(5)
    for n, letters in enumerate(["ab", "abcdefgh"] * 12):
        monkeypatch.setattr(alike, "WORDS", [1024, 3][n % 2])
        monkeypatch.setattr(alike, "PAIRS", [64, 2][n // 2 % 2])
        word = lambda: "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 5, 9, 120])))  # noqa: B023, E731
        strings = sorted({"", *(rng.choice(" |").join(word() for _ in range(rng.randint(1, 6))) for _ in range(20))})
        known = sorted({word()[:20] + rng.choice(" |") for _ in range(12)} - {" ", "|"})
        symbol = {c: k for k, c in enumerate(" |" + letters)}
        side = alike.Strings(strings, symbol)
        got = side.distances(known, symbol)
        want = [[to_substring(p, s + " ") for s in side.strings] for p in known]
        assert (got[:-1] <= np.array(want)).all() and (got[-1] == 0).all()
        # exact where no text of three words or more is closer
        assert (got[:-1] == np.array(want))[:, [len(alike.pieces(s)) < 3 for s in side.strings]].all()
    seen = []
    near = alike._Pieces.near
    monkeypatch.setattr(alike._Pieces, "near", lambda self, words, x, y: seen.append(len(x)) or near(self, words, x, y))
    strings = [f"{a} {b} {c}" for a in "klm" for b in "nop" for c in "qrs"]
    symbol = {c: k for k, c in enumerate(sorted(set("".join(strings))))}
    alike.Strings(strings, symbol).distances(["kn "], symbol)
    assert seen == [3 + 9 + 9]
