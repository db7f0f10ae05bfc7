"""Problem 4: near-duplicate records with small edits.

A record is the set of distinct words of its texts. DartMinHash signatures are
cut into bands that share no coordinate; records that agree in a whole band are
candidates, which are thinned by a bound on their words that no similar pair
fails and then verified exactly on their words. Nothing is compared all against
all and nothing is collected.

Layout for scale: one pass over the texts makes compact blobs of (band key, word
set), grouped by hash into buckets whose number grows with the data. A word set
goes by its 64-bit digest, so all records that hold it are one member of a band
wherever they lie: a task sends it once, and a bucket folds what several tasks
sent before anything is paired. Copies are told by a small table of (word set,
record) and never paired.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.dartminhash import DartMinHash, mix
from millrace.operators.dedup import components
from millrace.session import cut, written

ROWS, BANDS = 9, 128
#: A coordinate of its own for each row of each band, so that bands are independent and a pair of similarity s is missed with (1 - s ** ROWS) ** BANDS.
COORDINATES = ROWS * BANDS
SKETCH_BITS = 256
SIGNED_AT_ONCE = 1_000
ENTRIES_A_BUCKET = 1_000_000
BLOB_ENTRIES = 2_000_000
#: Record keys up to which the keys of surviving pairs are broadcast; beyond, the same filter is a shuffled join.
BROADCAST_KEYS = 500_000
WORD = re.compile(r"[^\W_]+")
JVM_WORD = r"[\p{L}\p{N}]+"
ENTRY = np.dtype([("h", "<u4"), ("k", "<i8")])
SKETCH = [f"s{n}" for n in range(SKETCH_BITS // 64)]
PAIR = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), *[(s, pa.int64()) for s in SKETCH]])


def band_keys(signatures: np.ndarray, seed: int = 7) -> np.ndarray:
    """(records, BANDS) 64-bit keys; each band hashes ROWS coordinates of its own."""
    odd = np.random.default_rng(seed).integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
    return mix((signatures.reshape(-1, BANDS, ROWS) * odd).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 1)


def sketch(ids: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits of a word set: is the number of words hashed to a bit odd? Two sets differ in as many words as bits, at least."""
    odd = np.bincount((ids >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _signed(buckets: int):
    """Texts to blobs: band entries of word sets (kind 0), their sizes and sketches (kind 1), and (word set, record) of every record (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dart = DartMinHash(COORDINATES)
        hashes: dict[str, int] = {}
        known: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        records: list[tuple[int, int]] = []
        digests: list[int] = []
        sets: list[np.ndarray] = []

        def hold() -> None:
            if digests:
                signatures = dart.signatures([s.tolist() for s in sets])
                held.append((np.array(digests, dtype=np.int64), band_keys(signatures), np.array([len(s) for s in sets], dtype=np.int64), np.stack([sketch(s) for s in sets])))
                digests.clear(), sets.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, int, bytes]] = []
            if held:
                keys = np.concatenate([k for k, *_ in held])
                bands = np.concatenate([b for _, b, *_ in held])
                bucket = (bands >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, axis=None, kind="stable")
                flat = np.empty(bands.size, dtype=ENTRY)
                flat["h"] = (bands & np.uint64(0xFFFFFFFF)).ravel()
                flat["k"] = np.repeat(keys, BANDS)
                flat, bucket = flat[order], bucket.ravel()[order]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                out += [(int(bucket[s]), 0, flat[s:e].tobytes()) for s, e in zip(starts, [*starts[1:], len(bucket)])]
                out.append((int(mix(keys[:1].view(np.uint64), 3)[0] % np.uint64(buckets)), 1, np.column_stack([keys, np.concatenate([n for *_, n, _ in held]), np.concatenate([s for *_, s in held])]).tobytes()))
                held.clear()
            if records:
                out.append((records[0][1] % buckets, 2, np.array(records, dtype=np.int64).tobytes()))
                records.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "data"])

        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                if not words:
                    continue
                ids = [hashes.get(w) for w in words]
                if None in ids:
                    if len(hashes) > 1_000_000:
                        hashes.clear()
                    ids = [xxhash.xxh64_intdigest(w) for w in words]
                    hashes.update(zip(words, ids))
                ids = np.array(ids, dtype=np.uint64)
                ids.sort()
                digest = xxhash.xxh64_intdigest(ids.tobytes()) - (1 << 63)
                records.append((digest, key))
                if digest in known:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                known.add(digest)
                digests.append(digest)
                sets.append(ids)
                size += BANDS
                if len(digests) == SIGNED_AT_ONCE:
                    hold()
            if size > BLOB_ENTRIES or len(records) > BLOB_ENTRIES:
                hold()
                yield from flush()
                size = 0
        hold()
        yield from flush()

    return run


def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    rows = len(columns[0])
    filled = [np.full(rows, kind, dtype=np.int32), *columns]
    return pa.RecordBatch.from_arrays([*map(pa.array, filled), *[pa.nulls(rows, f.type) for f in list(PAIR)[len(filled) :]]], schema=PAIR)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: candidate pairs of word sets (kind 0), sketches (kind 1) and records (kind 2)."""
    blobs = {0: [], 1: [], 2: []}
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
            blobs[kind].append(data)
    for kind, width in ((1, 2 + len(SKETCH)), (2, 2)):
        for data in blobs[kind]:
            rows = np.frombuffer(data, dtype=np.int64).reshape(-1, width)
            yield _batch(kind, *[rows[:, n].copy() for n in range(width)])
    if not blobs[0]:
        return
    flat = np.frombuffer(b"".join(blobs[0]), dtype=ENTRY)
    blobs.clear()
    flat = flat[np.lexsort((flat["k"], flat["h"]))]
    flat = flat[np.r_[True, (flat["h"][1:] != flat["h"][:-1]) | (flat["k"][1:] != flat["k"][:-1])]]  # what several tasks sent, once
    h, k = flat["h"], flat["k"]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[starts, len(h)])
    # pairs at distance d inside their group, for d = 1, 2, ...: never more than a slice of the bucket at once
    alive = np.flatnonzero(sizes > 1)
    rest = np.repeat(starts + sizes, sizes) - np.arange(len(h))  # members from here to the end of the group
    at = np.flatnonzero(rest > 1) if len(alive) else np.empty(0, dtype=np.int64)
    found, count, d = [], 0, 1
    while len(at):
        a, b = k[at], k[at + d]
        found.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
        count += len(at)
        d += 1
        at = at[rest[at] > d]
        if count > 500_000 or not len(at):
            pairs = np.unique(np.concatenate(found), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield _batch(0, pairs[:, 0].copy(), pairs[:, 1].copy())
            found, count = [], 0


def words_of(text: Column) -> Column:
    """Hashes of the distinct lower-case words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(JVM_WORD), F.lit(0)), lambda w: F.xxhash64(w)))


def _similar(records: DataFrame, key: str, texts: list[str], share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(a, b) of similar word sets, and (d, id) of the records of every word set that is similar to another or held by several records."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in texts])
    base = records.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("k"), F.col(key).alias("id"), text.alias("text"))
    buckets = max(48, -(-records.count() * BANDS // ENTRIES_A_BUCKET))
    signed = base.select("k", "text").mapInArrow(_signed(buckets), "bucket int, kind int, data binary")
    # a task a bucket: left to itself, Spark puts many of these few large rows into one task
    schema = "kind int, a long, b long, " + ", ".join(f"{s} long" for s in SKETCH)
    found = written(signed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_paired, schema), "near-duplicates")
    sketched = found.where("kind = 1").select(F.col("a").alias("k"), F.col("b").alias("n"), *SKETCH).dropDuplicates(["k"])
    side = lambda x: sketched.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), *[F.col(s).alias(f"{s}{x}") for s in SKETCH])
    first, second = side("a"), side("b")
    pairs = found.where("kind = 0").select("a", "b")
    differ = reduce(add, [F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in SKETCH])
    # sets of m and n words at the share p / q differ in (m + n) (q - p) / (p + q) words at most, and in no fewer than their sketches do
    may = differ * (share[0] + share[1]) <= (F.col("na") + F.col("nb")) * (share[1] - share[0])
    if found.where("kind = 1").count() <= BROADCAST_KEYS:
        near = pairs.join(F.broadcast(first), "a").join(F.broadcast(second), "b").where(may).select("a", "b").dropDuplicates()
    else:
        near = pairs.repartition("a").dropDuplicates(["a", "b"]).join(first, "a").join(second, "b").where(may).select("a", "b")
    near = written(near, "near-candidates")

    # of each word set one record stands for all; combined before the shuffle, so a set that a third of the records hold is a few rows
    holds = found.where("kind = 2").select(F.col("a").alias("d"), F.col("b").alias("k"))
    stands = cut(holds.groupBy("d").agg(F.min("k").alias("k"), (F.max("k") != F.min("k")).alias("copied")))
    paired = near.select(F.explode(F.array("a", "b")).alias("d")).dropDuplicates()
    wanted = stands.join(paired, "d", "left_semi").select("d", "k")
    chosen = base.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "k").dropDuplicates(["d"])
    words = chosen.select("d", words_of(F.col("text")).alias("w"))
    both = near.join(words.select(F.col("d").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("d").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    similar = cut(both.where(shared * (share[0] + share[1]) >= (F.size("wa") + F.size("wb")) * share[0]).select("a", "b"))

    linked = similar.select(F.explode(F.array("a", "b")).alias("d")).union(stands.where("copied").select("d")).dropDuplicates()
    members = holds.join(linked, "d", "left_semi").dropDuplicates(["k"])
    named = records.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("k"), F.col(key).alias("id"))
    return similar, named.join(F.broadcast(members) if members.count() <= BROADCAST_KEYS else members, "k").select("d", "id").dropDuplicates(["id"])


def similar_pairs(records: DataFrame, key: str, texts: list[str], share: tuple[int, int] = (3, 4)) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs whose words have at least share[0]/share[1] in common.

    Null texts count as empty; records without any word are in no pair; rows
    that repeat a key count once, with one of their texts; equal word sets are
    pairs too. Similarity is verified exactly; a pair at 0.75 is missed with
    probability 5e-5, one at 0.76 with 1e-5, one at 0.80 with 1e-8 (README).
    """
    similar, members = _similar(records, key, texts, share)
    members = cut(members)
    inside = members.select("d", F.col("id").alias("ia")).join(members.select("d", F.col("id").alias("ib")), "d").where("ia < ib").select("ia", "ib")
    across = similar.join(members.select(F.col("d").alias("a"), F.col("id").alias("ia")), "a").join(members.select(F.col("d").alias("b"), F.col("id").alias("ib")), "b").select("ia", "ib")
    return across.union(inside).select(F.least("ia", "ib").alias(f"{key}_a"), F.greatest("ia", "ib").alias(f"{key}_b"))


def similar_groups(records: DataFrame, key: str, texts: list[str], share: tuple[int, int] = (3, 4)) -> DataFrame:
    """(key, group_id, n_links) of every record in a group of two or more; a group holds all that pairs connect.

    group_id is the smallest key of the group. Of equal word sets the record of
    the smallest key stands for the others: its n_links counts the word sets
    similar to its own and its copies, that of a copy is 1. Copies aren't
    expanded into pairs, so a group of any size stays a row each.
    """
    similar, members = _similar(records, key, texts, share)
    members = cut(members)
    sets = members.groupBy("d").agg(F.min("id").alias("stand"), (F.count("*") - 1).alias("copies"))
    links = similar.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count("*").alias("links"))
    named = components(sets.select(F.col("d").alias("v")), similar).select(F.col("v").alias("d"), "component")
    known = cut(sets.join(links, "d", "left").join(named, "d"))
    least = known.groupBy("component").agg(F.min("stand").alias("group_id"))
    of_set = known.join(least, "component").select("d", "stand", "group_id", (F.coalesce("links", F.lit(0)) + F.col("copies")).alias("links"))
    return members.join(of_set, "d").select(F.col("id").alias(key), "group_id", F.when(F.col("id") == F.col("stand"), F.col("links")).otherwise(F.lit(1)).cast("long").alias("n_links"))
