"""Pairs of word sets that may share half of their words: parities of hashed words bound how many words differ."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of 64 bits of a sketch, and of a short one that they are folded to, which is compared first.
WIDTH, SHORT = 10, 4
#: Right sketches compared at once, and rows sketched at once.
TILE, SLICE = 16384, 1000


def spread(shares: dict[str, float]) -> dict[str, int]:
    """A bit for each word, of which such a share of all sets holds it, so that each bit of a short sketch is odd about as often.

    Sketches of unlike sets then differ in more bits than those of hashed words.
    """
    bins = [(0.0, k) for k in range(64 * SHORT)]
    members = [0] * len(bins)
    out: dict[str, int] = {}
    for word, p in sorted(shares.items(), key=lambda x: (-x[1], x[0])):
        odd, k = heapq.heappop(bins)
        # the bits that are folded to one take turns
        turns = range(k, 64 * WIDTH, len(bins))
        out[word] = turns[members[k] % len(turns)]
        members[k] += 1
        heapq.heappush(bins, (odd + p - 2 * odd * p, k))
    return out


def _short(bits: np.ndarray) -> np.ndarray:
    """Parities of the bits of a sketch that lie ``SHORT`` words apart."""
    out = bits[:, :SHORT].copy()
    for k in range(SHORT, WIDTH):
        out[:, k % SHORT] ^= bits[:, k]
    return out


def sketches(words: pa.ListArray, own: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, numbers of distinct words) of lists of words; empty words don't count, null is an empty list.

    A bit is the parity of the words that are its ``own`` or hashed to it, so two
    sets differ in at least as many words as their sketches in bits.
    """
    place = own or {}
    coded = words.flatten().dictionary_encode()
    named = coded.dictionary.to_pylist()
    bit = np.array([place[w] if w in place else zlib.crc32(w.encode()) % (64 * WIDTH) if w else -1 for w in named], dtype=np.int64)
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out, size = np.zeros((len(words), WIDTH), dtype=np.uint64), np.zeros(len(words), dtype=np.int64)
    ends = np.searchsorted(row, np.arange(0, len(words) + SLICE, SLICE))
    for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
        first, n = k * SLICE, min(SLICE, len(words) - k * SLICE)
        at, word = np.divmod(np.unique((row[lo:hi] - first) * len(named) + code[lo:hi]), max(1, len(named)))
        at, held = at[bit[word] >= 0], bit[word[bit[word] >= 0]]
        size[first : first + n] = np.bincount(at, minlength=n)
        odd = (np.bincount(at * 64 * WIDTH + held, minlength=n * 64 * WIDTH) % 2).astype(bool)
        out[first : first + n] = np.packbits(odd.reshape(n, -1), axis=1).view(np.uint64)
    return out, size


def may_share_half(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, right sets) of all pairs that no bound keeps from sharing half of their words: at most a third of all words of both differ."""
    bits, size = left
    order = np.argsort(size, kind="stable")
    short = _short(bits)[:, :, None]
    for lo in range(0, len(right[1]), TILE):
        other, n = right[0][lo : lo + TILE], right[1][lo : lo + TILE]
        columns = np.ascontiguousarray(_short(other).T)
        room, times = np.empty(columns.shape, dtype=np.uint64), np.empty(columns.shape, dtype=np.uint8)
        apart, near = np.empty(len(n), dtype=np.uint8), np.empty(len(n), dtype=bool)
        last, limit = -1, apart
        for i in order.tolist():
            if size[i] != last:
                last = int(size[i])
                limit = np.minimum((last + n) // 3, 255).astype(np.uint8)
            np.bitwise_xor(columns, short[i], out=room)
            np.bitwise_count(room, out=times)
            # what goes beyond 255 begins at 0 again, so nothing is lost
            np.add.reduce(times, axis=0, dtype=np.uint8, out=apart)
            np.less_equal(apart, limit, out=near)
            at = np.flatnonzero(near)
            if len(at):
                at = at[3 * np.bitwise_count(other[at] ^ bits[i]).sum(axis=1, dtype=np.int64) <= last + n[at]]
                if len(at):
                    yield i, at + lo
