"""Alike strings of two lists: sound bounds on the Indel distance first, the longest common subsequence of what is left."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

#: Pieces of strings that have a row of distances, how long one may be, and how often it must occur to repay the row: where marks are high and where they are low.
PIECES, LONG, OFTEN = 512, 24, (200, 20)
#: Words of 64 bits of a letter sketch; letters are hashed into CLASSES.
SKETCH, CLASSES = 3, 64
#: Words whose states are kept and pairs of words handled at once while distances are filled in, and pairs whose subsequences are found at once.
WORDS, PAIRS, BATCH = 1024, 64, 8192
#: Rows whose pairs are gathered before they are scored, and best-looking pairs of a row that set its first mark.
ROWS, SEEDS = 128, 24


def pieces(s: str) -> list[str]:
    """``s`` and a blank, cut behind every blank and bar."""
    return re.findall(r"[^ |]*[ |]", s + " ")


class _Pieces:
    """Least Indel distances of pieces to the text of two neighbouring words, and to text that reaches beyond the second one."""

    def __init__(self, known: list[str], symbol: dict[str, int]):
        self.order = sorted(range(len(known)), key=lambda k: -len(known[k]))
        rows = [[symbol[c] for c in known[k]] for k in self.order]
        size = [len(row) for row in rows]
        # longer pieces come first: letter i is one of the first count[i] pieces
        self.count = [sum(n >= i for n in size) for i in range(max(size) + 2)]
        self.unlike = [np.empty(0)]
        for i in range(1, max(size) + 1):
            at = np.full((len(symbol), self.count[i]), 255, dtype=np.uint8)
            at[[row[i - 1] for row in rows[: self.count[i]]], np.arange(self.count[i])] = 0
            self.unlike.append(at)

    def fresh(self, n: int) -> list[np.ndarray]:
        """The state of n rows before any letter: state[i][r, k] is the least distance of the first i letters of piece k to text that ends here."""
        return [np.full((n, k), i, dtype=np.uint8) for i, k in enumerate(self.count[:-1])]

    def read(self, state: list[np.ndarray], columns: np.ndarray, free: int) -> np.ndarray:
        """Move ``state`` on by columns of letters and return the least distance of whole pieces on the way; in rows from ``free`` on text may not begin any more."""
        one, least = np.uint8(1), np.full((len(state[0]), self.count[1]), 255, dtype=np.uint8)
        for letters in columns:
            before = state[0].copy()
            # what is beyond any piece's length needn't be exact
            np.minimum(state[0][free:] + one, np.uint8(4 * LONG), out=state[0][free:])
            for i in range(1, len(state)):
                k, row = self.count[i], state[i]
                # one more letter of either string is left out, or the letters agree
                new = np.minimum(state[i - 1][:, :k], row)
                np.add(new, one, out=new)
                room = self.unlike[i][letters]
                np.bitwise_or(room, before[:, :k], out=room)
                np.minimum(new, room, out=new)
                before, state[i] = row, new
                last = self.count[i + 1]
                if last < k:
                    np.minimum(least[:free, last:k], new[:free, last:], out=least[:free, last:k])
        return least

    def near(self, words: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(within, beyond) for pairs of words, a row a piece: the least distance to text of x and y that ends in y, and a bound for text with all of y that begins in x and ends behind y.

        x may be len(words): none. Text beyond y holds the blank behind it, which agrees with
        nothing as pieces end with theirs, and what follows may agree with the rest of a piece.
        """
        within, beyond = (np.empty((len(x), self.count[1]), dtype=np.uint8) for _ in range(2))
        size = np.array([len(w) for w in words] + [0])
        for first in range(0, len(words) + 1, WORDS):
            own = np.arange(first, min(first + WORDS, len(words) + 1))
            kept = self.fresh(len(own))
            for n in np.unique(size[own][size[own] > 0]):
                at = np.flatnonzero(size[own] == n)
                state = [row[at] for row in kept]
                self.read(state, np.array([words[k] for k in own[at]]).T, len(at))
                for row, new in zip(kept, state):
                    row[at] = new
            here = np.flatnonzero((x >= first) & (x < first + WORDS))
            for n in np.unique(size[y[here]]):
                alike = here[size[y[here]] == n]
                for lo in range(0, len(alike), PAIRS):
                    at = alike[lo : lo + PAIRS]
                    letters = np.array([words[k] for k in y[at]]).T
                    state = [np.tile(row[x[at] - first], (2, 1)) for row in kept]
                    least = self.read(state, np.tile(letters[:-1], (1, 2)), len(at))
                    full = np.full((len(at), self.count[1]), 255, dtype=np.uint8)
                    for i, row in enumerate(state):
                        k = self.count[i]
                        np.minimum(full[:, :k], row[len(at) :], out=full[:, :k])
                    beyond[at] = full + np.uint8(1)
                    within[at] = np.minimum(least[: len(at)], self.read([row[: len(at)] for row in state], letters[-1:], len(at)))
        back = np.argsort(self.order)
        return tuple(np.ascontiguousarray(t.T[back]) for t in (within, beyond))


class Strings:
    """Strings in order of length and text, with what the bounds need."""

    def __init__(self, strings: list[str], symbol: dict[str, int]):
        self.strings = sorted(strings, key=lambda s: (len(s), s))
        self.size = np.array([len(s) for s in self.strings], dtype=np.int64)
        n, most = len(strings), int(self.size.max(initial=0))
        # the last symbol stands beyond the end
        self.codes = np.full((n, most), len(symbol), dtype=np.uint16 if len(symbol) < 65535 else np.int32)
        flat = np.array([symbol[c] for s in self.strings for c in s], dtype=self.codes.dtype)
        self.codes[np.arange(most) < self.size[:, None]] = flat
        row = np.repeat(np.arange(n), self.size)
        letter = np.frombuffer("".join(self.strings).encode("utf-32-le"), dtype=np.uint32) % CLASSES
        self.bag = np.minimum(np.bincount(row * CLASSES + letter, minlength=n * CLASSES), 255).astype(np.uint8).reshape(n, CLASSES)

    def sketch(self, marks: list[tuple[int, int]]) -> None:
        """Bits of whether a letter occurs more than so many times: two strings differ in at most as many bits as their distance."""
        bits = np.zeros((len(self.strings), 64 * SKETCH), dtype=bool)
        for k, (c, t) in enumerate(marks):
            bits[:, k] = self.bag[:, c] > t
        self.bits = [np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64)[:, w]) for w in range(SKETCH)]

    def distances(self, known: list[str], symbol: dict[str, int]) -> np.ndarray:
        """A row for each known piece and one of zeros: no more than its least distance to any substring of each string and a blank behind it.

        Words that are neighbours in many strings are looked at once.
        """
        out = np.zeros((len(known) + 1, len(self.strings)), dtype=np.uint8)
        if not known or not self.strings:
            return out
        cut = [pieces(s) for s in self.strings]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(p, len(number)) for row in cut for p in row], dtype=np.int64)
        ends = np.cumsum([len(row) for row in cut])
        starts = np.append(0, ends[:-1])
        before = np.append(len(number), flat[:-1])
        before[starts] = len(number)
        pairs, at = np.unique(before * (len(number) + 1) + flat, return_inverse=True)
        x, y = np.divmod(pairs, len(number) + 1)
        within, beyond = _Pieces(known, symbol).near([np.array([symbol[c] for c in p]) for p in number], x, y)
        # nothing is beyond the last word, and what begins at the first one and goes beyond the second is bounded there
        at += len(pairs)
        at[starts] -= len(pairs)
        at[ends[ends - starts > 1] - 1] -= len(pairs)
        table = np.concatenate([within, np.minimum(within, beyond)], axis=1)
        for k, p in enumerate(known):
            np.minimum(np.minimum.reduceat(table[k].take(at), starts), np.uint8(len(p)), out=out[k])
        return out


def _subsequences(a: Strings, b: Strings, i: np.ndarray, j: np.ndarray, symbols: int) -> np.ndarray:
    """LCS lengths of the pairs (i, j); i in order, from few rows of ``a``."""
    rows, at = np.unique(i, return_inverse=True)
    size = a.size[rows]
    width = max(1, -(-int(size.max()) // 64))
    masks = np.zeros((width, len(rows), symbols + 1), dtype=np.uint64)
    for k in range(int(size.max())):
        has = np.flatnonzero(size > k)
        masks[k // 64, has, a.codes[rows[has], k]] |= np.uint64(1 << (k % 64))
    masks = masks.reshape(width, -1)
    out = np.empty(len(i), dtype=np.int64)
    for lo in range(0, len(i), BATCH):
        own, other = at[lo : lo + BATCH], j[lo : lo + BATCH]
        n = len(own)
        index = np.ascontiguousarray(b.codes[other, : int(b.size[other].max())].T).astype(np.int64) + own * (symbols + 1)
        state = [np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64) for _ in range(width)]
        hit, total = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
        for column in index:
            carry = None
            for w in range(width):
                v = state[w]
                np.take(masks[w], column, out=hit, mode="clip")
                np.bitwise_and(hit, v, out=hit)
                np.add(v, hit, out=total)
                over = total < v if w + 1 < width else None
                if carry is not None:
                    np.add(total, carry, out=total)
                    over = over | (total < carry) if over is not None else None
                carry = over
                np.bitwise_xor(v, hit, out=v)
                np.bitwise_or(v, total, out=v)
        left = np.zeros(n, dtype=np.int64)
        for w in range(width):
            used = np.clip(a.size[rows][own] - 64 * w, 0, 64).astype(np.uint64)
            full = np.where(used == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (used & np.uint64(63))) - np.uint64(1))
            left += np.bitwise_count(state[w] & full)
        out[lo : lo + BATCH] = a.size[rows][own] - left
    return out


class Matcher:
    """Pairs of a string of ``left`` and one of ``right``; ``both_ways`` adds a bound that pays where marks are low."""

    def __init__(self, left: list[str], right: list[str], both_ways: bool):
        self.symbol = {c: k for k, c in enumerate(sorted(set("".join(left)) | set("".join(right)) | {" "}))}
        self.a, self.b = Strings(left, self.symbol), Strings(right, self.symbol)
        bag = self.b.bag
        even = sorted((abs(float((bag[:, c] > t).mean()) - 0.5), c, t) for c in range(CLASSES) for t in range(min(int(bag[:, c].max(initial=0)), 64)))
        for side in (self.a, self.b):
            side.sketch([(c, t) for _, c, t in even[: 64 * SKETCH]])
        often = OFTEN[both_ways]
        known, self.held = self._known(self.a, often)
        self.far = self.b.distances(known, self.symbol)
        self.parts, self.back = [], None
        if both_ways:
            known, held = self._known(self.b, often)
            self.parts = np.full((max(map(len, held), default=0), len(held)), len(known), dtype=np.int16)
            for k, row in enumerate(held):
                self.parts[: len(row), k] = row
            self.back = np.ascontiguousarray(self.a.distances(known, self.symbol).T)
        self.lengths, self.times = np.unique(self.b.size, return_counts=True)
        self.ends = np.cumsum(self.times)
        self.last: tuple[int, float] | None = None

    @staticmethod
    def _known(side: Strings, least: int) -> tuple[list[str], list[list[int]]]:
        """The frequent pieces, and the numbers of those in each string."""
        cut = [pieces(s) for s in side.strings]
        times = Counter(p for row in cut for p in row)
        known = [p for p, n in times.most_common(PIECES) if n >= least and 1 < len(p) <= LONG]
        number = {p: k for k, p in enumerate(known)}
        return known, [[number[p] for p in row if p in number] for row in cut]

    def _limits(self, n: int, mark: float) -> tuple[int, int, np.ndarray]:
        """(first, end, largest distances) of the right strings, as long as is needed to reach a ratio of ``mark`` with one of n letters."""
        # a little more, as marks are rounded; distances are whole
        limits = np.floor((n + self.lengths) * (1 - mark / 100) + 1e-6)
        fits = np.flatnonzero(np.abs(self.lengths - n) <= limits)
        # the pieces of a string have a letter more than it, or whole numbers are wider
        kind = np.uint8 if n < 255 else np.uint32
        if not len(fits):
            return 0, 0, np.empty(0, dtype=kind)
        fits = slice(fits[0], fits[-1] + 1)
        return int(self.ends[fits][0] - self.times[fits][0]), int(self.ends[fits][-1]), np.repeat(np.minimum(limits[fits], np.iinfo(kind).max).astype(kind), self.times[fits])

    def _bounds(self, i: int, mark: float) -> tuple[int, np.ndarray, np.ndarray]:
        """(first, bounds, limits) of the right strings, as long as is needed to reach a ratio of ``mark`` with string i."""
        n = int(self.a.size[i])
        if self.last != (n, mark):
            # strings of one length are neighbours, and in order of text: sums of shared first pieces are kept
            self.last, self.span, self.path = (n, mark), self._limits(n, mark), []
            self.sums = [np.zeros(self.span[1] - self.span[0], dtype=self.span[2].dtype)]
        lo, hi, limit = self.span
        held = self.held[i]
        k = 0
        while k < len(self.path) and k < len(held) and self.path[k] == held[k]:
            k += 1
        for k in range(k, len(held)):
            if k + 1 == len(self.sums):
                self.sums.append(np.empty_like(self.sums[0]))
            np.add(self.sums[k], self.far[held[k], lo:hi], out=self.sums[k + 1])
        self.path = held
        return lo, self.sums[len(held)], limit

    def _candidates(self, i: int, mark: float) -> np.ndarray:
        """The right strings that no bound keeps from reaching ``mark`` with string i."""
        lo, total, limit = self._bounds(i, mark)
        at = np.flatnonzero(total <= limit)
        limit, at = limit[at], at + lo
        if self.back is None or not len(at):
            return at
        good = self._apart(np.full(len(at), i), at) <= limit
        at, limit = at[good], limit[good]
        own, other = self.back[i], np.zeros(len(at), dtype=np.uint32)
        for row in self.parts:
            other += own[row[at]]
        return at[other <= limit]

    def _apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits of their sketches strings i and j differ."""
        apart = np.zeros(len(j), dtype=np.uint8)
        for own, bits in zip(self.a.bits, self.b.bits):
            apart += np.bitwise_count(bits[j] ^ own[i])
        return apart

    def _seeds(self, i: int, mark: float) -> np.ndarray:
        """A few strings that look closest."""
        lo, total, limit = self._bounds(i, mark)
        if not len(total):
            return np.empty(0, dtype=np.int64)
        at = np.flatnonzero(total <= int(total.min()) + 2)
        return at[np.argsort(total[at], kind="stable")[:SEEDS]] + lo

    def _scored(self, choose: Callable[[int, float], np.ndarray], marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, LCS) of all chosen pairs, some rows at a time."""
        i, j, n = [], [], 0
        last = len(self.a.strings) - 1
        for k in range(last + 1):
            at = choose(k, marks[k])
            if len(at):
                i.append(np.full(len(at), k))
                j.append(at)
                n += len(at)
            if i and (n >= 8 * BATCH or len(i) >= ROWS or k == last):
                own, other = np.concatenate(i), np.concatenate(j)
                if self.back is None:
                    # few of each row, so sketches are compared for many rows at once
                    good = self._apart(own, other) <= (self.a.size[own] + self.b.size[other]) * (1 - marks[own] / 100) + 1e-6
                    own, other = own[good], other[good]
                if len(own):
                    yield own, other, _subsequences(self.a, self.b, own, other, len(self.symbol))
                i, j, n = [], [], 0

    def pairs(self, threshold: int) -> Iterator[tuple[str, str, float]]:
        """(a, b, ratio) of all pairs with a ratio of at least ``threshold``."""
        for i, j, n in self._scored(self._candidates, np.full(len(self.a.strings), float(threshold))):
            total = self.a.size[i] + self.b.size[j]
            # whole numbers, so that exact thresholds don't hang on rounding
            good = 100 * (total - 2 * n) <= (100 - threshold) * total
            yield from self._named(i[good], j[good], n[good], total[good])

    def marks(self, floor: float) -> Iterator[tuple[str, float]]:
        """(a, ratio with one of the closest-looking strings), where that is ``floor`` at least."""
        for i, j, n in self._scored(self._seeds, np.full(len(self.a.strings), float(floor))):
            best = self._most(i, self._ratio(n, self.a.size[i] + self.b.size[j]))
            yield from ((self.a.strings[k], s) for k, s in best.items() if s >= floor)

    def best(self, marks: dict[str, float], only: bool = True) -> Iterator[tuple[str, str, float]]:
        """(a, b, ratio) of the closest strings of each left one, all equal ones (not ``only``: of all), where they reach its mark."""
        least = np.array([marks[s] for s in self.a.strings], dtype=np.float64)
        for i, j, n in self._scored(self._candidates, least):
            total = self.a.size[i] + self.b.size[j]
            ratio = self._ratio(n, total)
            good = ratio >= least[i]
            if only:
                best = self._most(i, ratio)
                good &= ratio == np.array([best[k] for k in i.tolist()])
            yield from self._named(i[good], j[good], n[good], total[good])

    @staticmethod
    def _ratio(n: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(total == 0, 100.0, 200.0 * n / np.maximum(total, 1))

    @staticmethod
    def _most(i: np.ndarray, ratio: np.ndarray) -> dict[int, float]:
        first = np.flatnonzero(np.diff(i, prepend=-1))
        return dict(zip(i[first].tolist(), np.maximum.reduceat(ratio, first).tolist()))

    def _named(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, total: np.ndarray) -> Iterator[tuple[str, str, float]]:
        return zip([self.a.strings[k] for k in i.tolist()], [self.b.strings[k] for k in j.tolist()], self._ratio(n, total).tolist())
