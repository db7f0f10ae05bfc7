"""Problem 7: documents packed into containers of fixed capacity.

Only the histogram of piece sizes decides a packing, and it has at most as
many entries as a container has tokens. So the histogram is counted over all
documents, one bounded plan is made from it, and every piece finds its
container from its size and its rank among pieces of that size. No piece and
no container is ever collected, however many there are.

The plan is large-item matching: pieces above a third of the capacity meet at
most in pairs, matched greedily from the largest with the largest that still
fits; smaller pieces then go, largest first, to the tightest gap (best fit).
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this byte-level vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Largest capacity; it bounds the plan and the histogram.
MAX_CAPACITY = 1 << 20
#: Characters tokenized at once; longer texts are cut before white space, where a token starts anyway.
SEGMENT = 200_000


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens); null and empty texts have no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            counts = []
            for text in pdf["text"]:
                n, start = 0, 0
                while start < len(text):
                    end = start + SEGMENT
                    if end < len(text):
                        space = text.rfind(" ", start + 1, end)
                        while space > start and text[space - 1].isspace():
                            space = text.rfind(" ", start + 1, space)
                        end = space if space > start else end
                    n += len(encoding.encode_ordinary(text[start:end]))
                    start = end
                counts.append(n)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array(counts, dtype="int64")})

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, n_tokens long")


@dataclass
class Plan:
    """Runs of pieces: size -> [(first rank, first bin, pieces a bin)], and how many bins there are."""

    capacity: int
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    bins: int = 0

    def place(self, size: int, rank: int) -> int:
        """The bin of the ``rank``-th piece of ``size``."""
        runs = self.runs[size]
        first, start, each = runs[bisect.bisect_right(runs, (rank, float("inf"), 0)) - 1]
        return start + (rank - first) // each


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Large-item matching of ``histogram`` (size -> pieces, sizes 1 to capacity)."""
    plan = Plan(capacity)
    used: dict[int, int] = {}
    # gap -> [(first bin, bins)]
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes_of_gaps: list[int] = []

    def put(size: int, start: int, n: int, each: int = 1) -> None:
        rank = used.get(size, 0)
        plan.runs.setdefault(size, []).append((rank, start, each))
        used[size] = rank + n

    def open_gap(gap: int, start: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes_of_gaps, gap)
        gaps[gap].append((start, n))

    left = {s: n for s, n in histogram.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        n = left[s]
        # the largest partner that fits beside it
        k = bisect.bisect_right(large, capacity - s) - 1
        if k < 0:
            put(s, plan.bins, n)
            open_gap(capacity - s, plan.bins, n)
            plan.bins += n
            large.pop()
            continue
        t = large[k]
        if t == s:
            pairs = n // 2
            if pairs:
                put(s, plan.bins, 2 * pairs, 2)
                open_gap(capacity - 2 * s, plan.bins, pairs)
                plan.bins += pairs
            left[s] = n - 2 * pairs
            if left[s] == 0:
                large.pop()
            else:
                # one is over: it pairs with the next smaller size, if any
                if k == 0:
                    put(s, plan.bins, 1)
                    open_gap(capacity - s, plan.bins, 1)
                    plan.bins += 1
                    large.pop()
                else:
                    t = large[k - 1]
                    put(s, plan.bins, 1)
                    put(t, plan.bins, 1)
                    open_gap(capacity - s - t, plan.bins, 1)
                    plan.bins += 1
                    large.pop()
                    left[t] -= 1
                    if left[t] == 0:
                        large.remove(t)
            continue
        pairs = min(n, left[t])
        put(s, plan.bins, pairs)
        put(t, plan.bins, pairs)
        open_gap(capacity - s - t, plan.bins, pairs)
        plan.bins += pairs
        left[s] -= pairs
        left[t] -= pairs
        if left[t] == 0:
            large.pop(k)
        if left[s] == 0:
            large.remove(s)
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[s]
        while n:
            k = bisect.bisect_left(sizes_of_gaps, s)
            if k == len(sizes_of_gaps):
                each = capacity // s
                full, rest = divmod(n, each)
                if full:
                    put(s, plan.bins, full * each, each)
                    open_gap(capacity - each * s, plan.bins, full)
                    plan.bins += full
                if rest:
                    put(s, plan.bins, rest, rest)
                    open_gap(capacity - rest * s, plan.bins, 1)
                    plan.bins += 1
                break
            gap = sizes_of_gaps[k]
            start, many = gaps[gap].pop()
            # the tightest gap takes as many as fit before the next bin is touched
            each = gap // s
            full = min(many, n // each)
            if full:
                put(s, start, full * each, each)
                open_gap(gap - each * s, start, full)
                n -= full * each
            if full < many:
                if n and n < each:
                    put(s, start + full, n, n)
                    open_gap(gap - n * s, start + full, 1)
                    n, full = 0, full + 1
                if full < many:
                    gaps[gap].append((start + full, many - full))
            if gap in gaps and not gaps[gap]:
                del gaps[gap]
                sizes_of_gaps.remove(gap)
    return plan


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack_id, bin_id, doc_id, piece, first_token, n_tokens): every token of every document in one container of each capacity.

    A document is one piece unless it is longer than the capacity; then all its
    pieces but the last fill a container. Documents without tokens are in no
    container. Equal sizes are ranked by where their rows lie. doc_id must be
    unique; containers of no positive capacity, or of over MAX_CAPACITY, are
    refused.
    """
    kinds = [(r.pack_id, r.capacity_tokens) for r in containers.select("pack_id", "capacity_tokens").dropDuplicates().limit(1_001).collect()]
    if len(kinds) > 1_000 or any(c is None or not 0 < c <= MAX_CAPACITY for _, c in kinds):
        raise ValueError("container capacities must be positive, bounded and few")
    counted = cut(token_counts(documents, vocabulary))

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], int] = {}
        part = TaskContext.get().partitionId()
        for pdf in batches:
            for pack_id, capacity in kinds:
                n = pdf["n_tokens"].to_numpy()
                pieces = -(-n // capacity)
                at = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(n[at] - piece * capacity, capacity)
                rank = pd.Series(size).groupby(size).cumcount().to_numpy() if len(size) else np.empty(0, dtype="int64")
                names, counts = np.unique(size, return_counts=True)
                base = np.array([seen.get((pack_id, int(s)), 0) for s in names], dtype="int64")
                for s, c in zip(names, counts):
                    seen[pack_id, int(s)] = seen.get((pack_id, int(s)), 0) + int(c)
                rank = rank + base[np.searchsorted(names, size)] if len(size) else rank
                yield pd.DataFrame({"pack_id": np.full(len(at), pack_id, dtype="int64"), "doc_id": pdf["doc_id"].to_numpy()[at], "piece": piece.astype("int32"), "size": size.astype("int32"), "part": np.full(len(at), part, dtype="int32"), "rank": rank.astype("int64")})

    items = cut(counted.mapInPandas(ranked, "pack_id long, doc_id long, piece int, size int, part int, rank long"))
    by_part = items.groupBy("pack_id", "size", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pack_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(by_part.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram: dict[int, dict[int, int]] = {p: {} for p, _ in kinds}
    for r in offsets.groupBy("pack_id", "size").agg(F.sum("n").alias("n")).collect():
        histogram[r.pack_id][r.size] = r.n
    plans = {p: make_plan(histogram[p], c) for p, c in kinds}
    capacities = dict(kinds)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = {(p, s): tuple(np.array(x, dtype="int64") for x in zip(*rs)) for p, plan in plans.items() for s, rs in plan.runs.items()}
        for pdf in batches:
            rank = pdf["rank"].to_numpy() + pdf["offset"].to_numpy()
            bins = np.empty(len(pdf), dtype="int64")
            for (p, s), at in pdf.groupby(["pack_id", "size"]).indices.items():
                first, start, each = runs[p, s]
                k = np.searchsorted(first, rank[at], side="right") - 1
                bins[at] = start[k] + (rank[at] - first[k]) // each[k]
            yield pd.DataFrame({"pack_id": pdf["pack_id"], "bin_id": bins, "doc_id": pdf["doc_id"], "piece": pdf["piece"], "first_token": pdf["piece"].astype("int64") * pdf["pack_id"].map(capacities).astype("int64"), "n_tokens": pdf["size"]})

    ready = items.join(offsets.select("pack_id", "size", "part", "offset"), ["pack_id", "size", "part"])
    return ready.select("pack_id", "doc_id", "piece", "size", "rank", "offset").mapInPandas(placed, "pack_id long, bin_id long, doc_id long, piece int, first_token long, n_tokens int")


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(pack_id, capacity_tokens, n_bins, least_bins, fill_share, largest_bin): how well a packing uses its containers."""
    bins = packed.groupBy("pack_id", "bin_id").agg(F.sum("n_tokens").alias("load"))
    each = bins.groupBy("pack_id").agg(F.count("*").alias("n_bins"), F.sum("load").alias("tokens"), F.max("load").alias("largest_bin"))
    share = F.col("tokens") / (F.col("n_bins") * F.col("capacity_tokens"))
    return each.join(F.broadcast(containers.select("pack_id", "capacity_tokens").limit(1_000)), "pack_id").select("pack_id", "capacity_tokens", "n_bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), F.round(share, 6).alias("fill_share"), "largest_bin")
