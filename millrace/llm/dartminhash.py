"""DartMinHash: sparse weighted signatures from hashed darts.

Every element throws darts into the plane of weight and rank. The plane is cut
into cells, each with its own stream of darts drawn from the hash of (element,
cell), so any two sets that hold an element share its darts. A dart counts if
it lies below the element's weight; each is hashed to one coordinate, and a
coordinate keeps the dart of the smallest rank. Two weighted sets agree in a
coordinate with the probability of their weighted Jaccard similarity.

With ``k`` coordinates a set of total weight W needs ranks up to about
``k (ln k + 2) / W``, which is all the darts ever generated for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Elements whose darts are drawn in one go; bounds the memory that takes.
DRAWN_AT_ONCE = 2_000


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of splitmix64 over an array."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class DartMinHash:
    """Signatures of ``k`` coordinates. ``keep`` bounds the memory of darts kept for elements seen before."""

    def __init__(self, k: int, seed: int = 1, keep: int = 50_000):
        self.k, self.seed, self.keep = k, seed, keep
        self.need = k * (math.log(k) + 2)
        self._darts: dict[tuple[int, int, float], tuple[np.ndarray, np.ndarray]] = {}
        self._unit: dict[float, dict[int, np.ndarray]] = {}
        self._units = 0

    def level(self, total_weight: float) -> float:
        """The rank is searched up to ``need / 2 ** level``; in halves, so that few darts are drawn in vain."""
        return math.floor(2 * math.log2(total_weight)) / 2

    def darts(self, element: int, weight_cells: int, level: float) -> tuple[np.ndarray, np.ndarray]:
        """(packed, height): rank in the high and identity in the low 32 bits, and the dart's height on the weight axis.

        ``weight_cells`` unit cells on the weight axis, ranks up to ``need / 2 ** level``.
        """
        key = (element, weight_cells, level)
        got = self._darts.get(key)
        if got is None:
            top = self.need / 2.0**level
            cells = max(1, math.ceil(top))
            packed, height = [], []
            for w in range(weight_cells):
                # the cells of ranks [c, c + 1) of this unit of weight: a Poisson number of darts each
                base = mix(np.uint64(element) + mix(np.arange(cells, dtype=np.uint64), w + 1), self.seed)
                count = POISSON.searchsorted((mix(base, 2) >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
                cell = np.repeat(np.arange(cells), count)
                nth = np.arange(count.sum(), dtype=np.uint64) - np.repeat(np.cumsum(count) - count, count).astype(np.uint64)
                dart = mix(np.repeat(base, count) + nth, 3)
                rank = (cell + (dart >> np.uint64(11)).astype(np.float64) * 2.0**-53) / self.need
                identity = mix(dart, 4)
                packed.append((np.minimum(rank * 2.0**31, 2.0**32 - 2).astype(np.uint64) << np.uint64(32)) | (identity & np.uint64(0xFFFFFFFF)))
                height.append(w + (mix(dart, 5) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            got = np.concatenate(packed), np.concatenate(height)
            if len(self._darts) >= self.keep:
                self._darts.clear()
            self._darts[key] = got
        return got

    def coordinates(self, packed: np.ndarray) -> np.ndarray:
        """The coordinate each dart is hashed to."""
        return ((packed & np.uint64(0xFFFFFFFF)) * np.uint64(self.k)) >> np.uint64(32)

    def _unit_darts(self, elements: np.ndarray, level: float) -> list[np.ndarray]:
        """The packed darts of many elements at weight 1, drawn together; the same as ``darts`` draws one by one."""
        cells = max(1, math.ceil(self.need / 2.0**level))
        base = mix(elements[:, None] + mix(np.arange(cells, dtype=np.uint64), 1), self.seed)
        count = POISSON.searchsorted((mix(base, 2) >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        each = count.ravel()
        nth = np.arange(each.sum(), dtype=np.uint64) - np.repeat(np.cumsum(each) - each, each).astype(np.uint64)
        dart = mix(np.repeat(base.ravel(), each) + nth, 3)
        cell = np.repeat(np.tile(np.arange(cells), len(elements)), each)
        rank = (cell + (dart >> np.uint64(11)).astype(np.float64) * 2.0**-53) / self.need
        packed = (np.minimum(rank * 2.0**31, 2.0**32 - 2).astype(np.uint64) << np.uint64(32)) | (mix(dart, 4) & np.uint64(0xFFFFFFFF))
        return np.split(packed, np.cumsum(count.sum(axis=1))[:-1])

    def learn(self, elements: Iterable[int], level: float) -> dict[int, np.ndarray]:
        """The darts of elements at weight 1 up to a level, remembered; what is new is drawn at once."""
        held = self._unit.setdefault(level, {})
        new = list({e for e in elements if e not in held})
        if self._units + len(new) > self.keep and self._units:
            self._unit, self._units = {level: (held := {})}, 0
            new = list(set(elements))
        for at in range(0, len(new), DRAWN_AT_ONCE):
            some = new[at : at + DRAWN_AT_ONCE]
            held.update(zip(some, self._unit_darts(np.array(some, dtype=np.uint64), level)))
        self._units += len(new)
        return held

    def signatures(self, sets: list[list[int]]) -> np.ndarray:
        """(sets, k): the signatures of many sets of element hashes, each of weight 1."""
        out = np.full((len(sets), self.k), EMPTY)
        open_sets = [(n, self.level(float(len(s)))) for n, s in enumerate(sets) if s]
        while open_sets:
            by_level: dict[float, list[int]] = {}
            for n, level in open_sets:
                by_level.setdefault(level, []).append(n)
            open_sets = []
            for level, at in by_level.items():
                held = self.learn([e for n in at for e in sets[n]], level)
                for n in at:
                    drawn = np.concatenate([held[e] for e in sets[n]])
                    np.minimum.at(out[n], self.coordinates(drawn).view(np.int64), drawn)
                    if (out[n] == EMPTY).any():
                        open_sets.append((n, level - 1))
        return out

    def signature(self, elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The k kept darts of a set of element hashes, by default of weight 1; EMPTY everywhere for an empty set."""
        if weights is None:
            return self.signatures([elements.tolist()])[0]
        kept = np.full(self.k, EMPTY)
        if len(elements) == 0:
            return kept
        level = self.level(float(weights.sum()))
        while True:
            parts = []
            for e, w in zip(elements.tolist(), weights.tolist()):
                packed, height = self.darts(e, max(1, math.ceil(w)), level)
                parts.append(packed[height < w])
            drawn = np.concatenate(parts)
            np.minimum.at(kept, self.coordinates(drawn).view(np.int64), drawn)
            if not (kept == EMPTY).any():
                return kept
            level -= 1


def _poisson(mean: float, most: int = 20) -> np.ndarray:
    p = math.exp(-mean)
    below, out = p, [p]
    for n in range(1, most):
        p *= mean / n
        below += p
        out.append(below)
    return np.array(out)


POISSON = _poisson(1.0)
