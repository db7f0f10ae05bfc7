"""Entity resolution: fuzzy pairs, clusters of a batch, and ordered checks against earlier postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import word_sets
from millrace.functions.alike import Matcher
from millrace.functions.similarity import ratio
from millrace.functions.text import jaccard, sorted_tokens, split_words, tokenize
from millrace.session import cut

#: Right strings of a unit of work at most, units that are made even of few strings, and left strings of a unit.
BLOCK, UNITS, GROUP = 36_000, 6, 120_000
#: Partitions for each unit, so that few units meet in one.
SPREAD = 16
#: Below this threshold strings are bounded from both sides.
LOW = 80
#: Above so many rows with alike descriptions in a unit their strings aren't compared with a row's one by one.
MANY = 200
#: Rows whose words say how frequent words are, and words at most that get bits by that.
SEEN, WORDS = 2000, 8192

# Thresholds of the batch clusters and of the check against earlier postings.
CLUSTER_AT, FUZZY_AT, AMBIGUOUS_AT, SHARED_WORDS = 85, 90, 70, 0.5


def _blocks(n: int, most: int, units: int) -> int:
    """How many blocks of at most ``most`` rows; ``units`` if each gets some work."""
    return max(1, -(-n // most), min(units, n // 500))


def _units(a: DataFrame, b: DataFrame | None, na: int, nb: int, by: tuple[str, ...] = ("s",)) -> tuple[DataFrame, int]:
    """(``a`` and ``b`` by unit y, z, how many units): side 0 holds left strings, side 1 right ones, which the left ones of side 2 are as well.

    The right strings of a unit are block y; its left ones are group z. Without
    ``b``, two different blocks meet once, in one of both units.
    """
    hashed = lambda n: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rest = [c for c in a.columns if c != "s"]
    if b is not None:
        left = a.withColumn("z", hashed(na)).withColumn("y", every(nb)).select("s", *rest, "y", "z", F.lit(0).alias("side"))
        right = b.withColumn("y", hashed(nb)).withColumn("z", every(na)).select("s", *[F.col(c) if c in b.columns else F.lit(None).cast(a.schema[c].dataType).alias(c) for c in rest], "y", "z", F.lit(1).alias("side"))
        return left.unionByName(right), na * nb
    group = max(1, GROUP // BLOCK) if nb > UNITS else nb
    groups = -(-nb // group)
    own = a.withColumn("x", hashed(nb)).withColumn("own", F.expr(f"cast(x div {group} as int)"))
    meets = (F.col("x") != F.col("y")) & ((F.col("x") < F.col("y")) == ((F.col("x") + F.col("y")) % 2 == 1))
    left = own.withColumn("y", every(nb)).where(meets).select("s", *rest, "y", F.col("own").alias("z"), F.lit(0).alias("side"))
    right = own.withColumn("z", every(groups)).select("s", *rest, F.col("x").alias("y"), "z", F.when(F.col("z") == F.col("own"), 2).otherwise(1).alias("side"))
    return left.unionByName(right), nb * groups


def _by_unit(units: DataFrame, number: int, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    # few bytes but much work: partitions are made by number, whatever the size of the strings
    return units.repartition(number * SPREAD if number < 64 else 4 * number, "y", "z").groupBy("y", "z").applyInPandas(score, schema)


def _distinct(strings: DataFrame) -> DataFrame:
    return cut(strings.select("s").where("s IS NOT NULL").dropDuplicates())


def fuzzy_join(left: DataFrame, right: DataFrame | None, threshold: int) -> DataFrame:
    """(a, b, score) for strings ``s`` of ``left`` and of ``right`` (None: left against itself, a < b) with a ratio of at least ``threshold``.

    Each distinct string is scored once. Blocks of strings meet in tasks, and
    only pairs that pass leave them.
    """
    a = _distinct(left)
    b = None if right is None else _distinct(right)
    count = (a if b is None else b).count()
    alone = b is None
    units, number = _units(a, b, 1 if alone else _blocks(a.count(), GROUP, 1), _blocks(count, BLOCK, UNITS))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second, own = (pdf["s"][pdf["side"].isin(k)].tolist() for k in ((0, 2), (1, 2), (2,)))
        rows: list[tuple[str, str, float]] = []
        if first and second:
            rows = list(Matcher(first, second, threshold < LOW).pairs(threshold))
        if alone:
            twice = set(own)
            rows = [(min(p, q), max(p, q), s) for p, q, s in rows if p < q or p not in twice]
        return pd.DataFrame(rows, columns=["a", "b", "score"])

    return _by_unit(units, number, score, "a string, b string, score double")


def closest(left: DataFrame, right: DataFrame, floor: int) -> DataFrame:
    """(a, b, score): the closest strings ``s`` of ``right`` to each of ``left``, all equal ones, with a ratio of at least ``floor``.

    A first pass scores a few pairs of each string, a second one what may be closer than the best of them.
    """
    a, b = _distinct(left), _distinct(right)
    na, nb = _blocks(a.count(), GROUP, 1), _blocks(b.count(), BLOCK, UNITS)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = (pdf["s"][pdf["side"] == k].tolist() for k in (0, 1))
        rows = list(Matcher(first, second, False).marks(floor)) if first and second else []
        return pd.DataFrame(rows, columns=["s", "mark"])

    seen = _by_unit(*_units(a, b, na, nb), mark, "s string, mark double").groupBy("s").agg(F.max("mark").alias("mark"))
    marked = cut(a.join(seen, "s", "left").select("s", F.coalesce("mark", F.lit(float(floor))).alias("mark")))
    return _most(_reaching(marked, b, na, nb, True, True))


def _most(pairs: DataFrame) -> DataFrame:
    found = cut(pairs)
    return found.join(found.groupBy("a").agg(F.max("score").alias("_most")), "a").where("score = _most").drop("_most")


def nearest(marked: DataFrame, right: DataFrame, low: bool) -> DataFrame:
    """(a, b, score): the closest of the different strings ``s`` of ``right`` to each of ``marked``, all equal ones, where they reach its ``mark``; ``low`` marks are bounded from both sides."""
    a = cut(marked)
    na, nb = (_blocks(t.count(), most, units) for t, most, units in ((a, GROUP, 1), (right, BLOCK, UNITS)))
    return _most(_reaching(a, right, na, nb, True, low))


def _reaching(marked: DataFrame, right: DataFrame, na: int, nb: int, only: bool, low: bool) -> DataFrame:
    """(a, b, score) of strings ``s`` of both sides with a ratio of at least a's ``mark``; ``only``: the closest ones of each unit."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = (pdf[pdf["side"] == k] for k in (0, 1))
        rows = list(Matcher(first["s"].tolist(), second["s"].tolist(), low).best(dict(zip(first["s"], first["mark"])), only)) if len(first) and len(second) else []
        return pd.DataFrame(rows, columns=["a", "b", "score"])

    return _by_unit(*_units(marked, right, na, nb), score, "a string, b string, score double")


def reaching(marked: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score) of all different strings ``s`` of both sides, each once there, with a ratio of at least a's ``mark``."""
    a, b = cut(marked), cut(right)
    nb = _blocks(b.count(), BLOCK, UNITS)
    found = [_reaching(part, b, _blocks(part.count(), GROUP, 1), nb, False, low) for part, low in ((a.where(F.col("mark") >= LOW), False), (a.where(F.col("mark") < LOW), True))]
    return found[0].unionByName(found[1]).where("a != b")


def _own_bits(rows: DataFrame) -> dict[str, int]:
    """Bits of frequent words. How often words are met in some rows only says which bits they get, not which rows are sketched."""
    words = rows.where("description IS NOT NULL").limit(SEEN).select(F.explode(F.array_distinct(split_words(F.col("description")))).alias("word"))
    seen = words.where("word != ''").groupBy("word").count().orderBy(F.desc("count"), "word").limit(WORDS).collect()
    return word_sets.spread({r.word: r["count"] / SEEN for r in seen})


def _sketched(rows: DataFrame, own: dict[str, int]) -> DataFrame:
    """(s, bits, n) of the different strings ``s`` and word sets of their descriptions, without empty ones."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, n = word_sets.sketches(batch.column("w"), own)
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array([row.tobytes() for row in bits], pa.binary()), pa.array(n, pa.int64())], names=["s", "bits", "n"])

    words = rows.where("s IS NOT NULL AND description IS NOT NULL").select("s", split_words(F.col("description")).alias("w"))
    return cut(words.mapInArrow(sketch, "s string, bits binary, n long").where("n > 0").dropDuplicates())


def _beside(a: DataFrame, b: DataFrame | None) -> DataFrame:
    """(s, mark) of sketched rows of ``a`` that may share half of their words with rows of ``b`` (None: of ``a``) of alike strings; two rows of ``a`` meet once."""
    alone, count = b is None, (a if b is None else b).count()
    units, number = _units(a, b, 1 if alone else _blocks(a.count(), GROUP, 1), _blocks(count, BLOCK, UNITS), ("s", "bits"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = (pdf[pdf["side"].isin(k)] for k in ((0, 2), (1, 2)))
        sets = [(np.frombuffer(b"".join(t["bits"]), dtype=np.uint64).reshape(-1, word_sets.WIDTH), t["n"].to_numpy()) for t in (first, second)]
        own, other = first["s"].tolist(), second["s"].tolist()
        marks: dict[str, float] = {}
        for i, at in word_sets.may_share_half(*sets):
            s, near = own[i], [other[j] for j in at.tolist()]
            for t in near:
                q = float(AMBIGUOUS_AT) if len(near) > MANY else ratio(s, t)
                if AMBIGUOUS_AT <= q < FUZZY_AT:
                    for u in (s, t) if alone else (s,):
                        marks[u] = min(q, marks.get(u, 100.0))
        return pd.DataFrame(list(marks.items()), columns=["s", "mark"])

    return _by_unit(units, number, score, "s string, mark double")


def described(left: DataFrame, right: DataFrame, told: DataFrame, among: bool = False) -> DataFrame:
    """(s, mark): the strings ``s`` of ``left`` that may have an alike string in ``right`` (``among``: or in ``left``), short of FUZZY_AT, with half of the words of the description.

    No such string is further than ``mark``, AMBIGUOUS_AT at least. A row whose
    string isn't returned can be a repeat by its string alone. ``told``: rows with
    some of the descriptions.
    """
    own = _own_bits(told)
    a, b = _sketched(left, own), _sketched(right, own)
    found = _beside(a, b)
    if among:
        found = found.unionByName(_beside(a, None))
    return cut(found.groupBy("s").agg(F.min("mark").alias("mark")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): the smallest member of each connected component. ``nodes``: v; ``edges``: a, b.

    Smallest labels travel along edges, to the neighbour and to the node it is
    labelled by, so whole groups join at once, and then jump to the label of
    their label; every round is written out, so lineage stays short.
    """
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").dropDuplicates())
    labels = cut(both.select(F.col("a").alias("v")).dropDuplicates().withColumn("c", F.col("v")))
    while True:
        met = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("c").alias("n")).join(labels.select(F.col("v").alias("a"), F.col("c").alias("own")), "a")
        near = met.select(F.explode(F.array("a", "own")).alias("v"), "n").groupBy("v").agg(F.min("n").alias("n"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        moved = cut(step.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c")))
        labels = moved.select("v", "c")
        if moved.where("c != old").limit(1).count() == 0:
            break
    return nodes.select("v").join(labels, "v", "left").select("v", F.coalesce("c", "v").alias("component"))


def cross_source_clusters(postings: DataFrame, seq: str, key: str, threshold: int = CLUSTER_AT) -> DataFrame:
    """``postings`` (with ``fp``) with ``cluster`` and ``kept``: the first of each cluster by ``seq`` stays.

    Rows of one fingerprint are one node, so copies cost nothing.
    """
    pairs = fuzzy_join(postings.select(F.col("fp").alias("s")), None, threshold)
    named = components(postings.select(F.col("fp").alias("v")).dropDuplicates(), pairs)
    rows = postings.join(named.withColumnRenamed("v", "fp").withColumnRenamed("component", "cluster"), "fp", "left")
    first = rows.groupBy("cluster").agg(F.min(F.struct(seq, key)).alias("_first"))
    return rows.join(first, "cluster").withColumn("kept", F.struct(seq, key) == F.col("_first")).drop("_first")


def best_matches(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_id, old_id, score): the best token-sort match of each new row, the earliest among equals; only scores of at least 70.

    ``new``: new_id, text; ``existing``: old_id, text, rank.
    """
    n = new.withColumn("s", sorted_tokens(F.col("text")))
    e = existing.withColumn("s", sorted_tokens(F.col("text")))
    return _first_of(n, e, closest(n, e, AMBIGUOUS_AT))


def _first_of(n: DataFrame, e: DataFrame, pairs: DataFrame) -> DataFrame:
    owner = e.groupBy(F.col("s").alias("b")).agg(F.min(F.struct("rank", "old_id")).alias("o"))
    best = pairs.join(owner, "b").groupBy("a").agg(F.min_by(F.struct(F.col("o.old_id").alias("old_id"), "score"), F.struct(F.negate(F.col("score")), "o")).alias("m"))
    return n.select("new_id", F.col("s").alias("a")).join(best, "a").select("new_id", "m.old_id", "m.score")


def dedup_check(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_id, canonical_id, match_type, match_score) of the new rows that repeat an existing one.

    ``new``: new_id, url, text, description; ``existing``: old_id, rank, url,
    text, description. An equal url decides; else the best match with at least
    90, or from 70 on if that match shares half of the words of the description.
    """
    by_url = existing.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("rank", "old_id")).alias("o"))
    exact = new.join(by_url, "url").select("new_id", F.col("o.old_id").alias("canonical_id"), F.lit("url_exact").alias("match_type"), F.lit(None).cast("double").alias("match_score"))
    rest = new.join(exact.select("new_id"), "new_id", "left_anti")
    string = sorted_tokens(F.col("text")).alias("s")
    n, e = cut(rest.select("new_id", string)), cut(existing.select("old_id", "rank", string))
    stored = _distinct(e)
    # short of FUZZY_AT a match counts only with an alike description, so it is sought only where there is one
    sure = cut(nearest(n.select("s").dropDuplicates().withColumn("mark", F.lit(float(FUZZY_AT))), stored, False))
    low = described(rest.select(string, "description").join(sure.select(F.col("a").alias("s")), "s", "left_anti"), existing.select(string, "description"), existing)
    best = cut(_first_of(n, e, sure.unionByName(nearest(low, stored, True))))
    close = best.where(F.col("score") >= FUZZY_AT).select("new_id", F.col("old_id").alias("canonical_id"), F.lit("fuzzy_title_company").alias("match_type"), F.bround(F.col("score") / 100, 4).alias("match_score"))
    # words are read of few descriptions, after the joins
    told = best.where(F.col("score") < FUZZY_AT).join(rest.select("new_id", F.col("description").alias("dn")), "new_id").join(existing.select("old_id", F.col("description").alias("do")), "old_id")
    shared = jaccard(tokenize(F.col("dn")), tokenize(F.col("do")))
    alike = told.select("new_id", F.col("old_id").alias("canonical_id"), F.lit("description_similarity").alias("match_type"), shared.alias("match_score")).where(F.col("match_score") >= SHARED_WORDS)
    return exact.unionByName(close).unionByName(alike)


def resolve_in_order(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_id, decision, canonical_id, match_score): the sequential check of a batch against what exists and what it accepted before.

    ``batch``: new_id, seq, url, text, description; ``existing``: old_id, rank,
    url, text, description. A url seen before drops the row (within_run_dup).
    A row's decision hangs on its best match that is not dropped: it is made as
    soon as that match is decided, for all rows at once, round by round, so no
    chain of similar rows is gathered in one task. Of the rows of one string
    only the first accepted and the first undecided one can be a match, so rows
    meet strings, never each other.
    """
    old_urls = existing.where("url IS NOT NULL").select("url").dropDuplicates()
    firsts = batch.where("url IS NOT NULL").groupBy("url").agg(F.min("seq").alias("_first"))
    seen = batch.join(firsts, "url", "left").join(old_urls.withColumn("_old", F.lit(True)), "url", "left")
    repeat = F.col("_old").isNotNull() | (F.coalesce("_first", "seq") != F.col("seq"))
    within = seen.where(repeat).select("new_id", F.lit("within_run_dup").alias("decision"), F.lit(None).cast("string").alias("canonical_id"), F.lit(None).cast("double").alias("match_score"))
    rows = cut(seen.where(~repeat).select("new_id", "seq", sorted_tokens(F.col("text")).alias("s")))
    olds = cut(existing.select("old_id", "rank", sorted_tokens(F.col("text")).alias("s")))
    strings, stored = _distinct(rows), _distinct(olds)
    sure = cut(nearest(strings.withColumn("mark", F.lit(float(FUZZY_AT))), stored, False))
    # short of FUZZY_AT a match counts only with an alike description, so it is sought only where there is one
    texts = rows.join(sure.select(F.col("a").alias("s")), "s", "left_anti").join(batch.select("new_id", "description"), "new_id").select("s", "description")
    low = described(texts, existing.select(sorted_tokens(F.col("text")).alias("s"), "description"), batch.select("description").unionByName(existing.select("description")), True)
    against = sure.unionByName(nearest(low, stored, True))
    # order: existing by rank, then the batch by seq
    owners = olds.groupBy(F.col("s").alias("b")).agg(F.min(F.struct("rank", "old_id")).alias("o"))
    known = cut(against.join(owners, "b").groupBy(F.col("a").alias("s")).agg(F.min_by(F.struct(F.col("o.old_id").alias("other"), "score"), F.struct(F.negate(F.col("score")), "o")).alias("old")))
    # a string that is sure to repeat a stored row is never accepted, so nothing waits for it
    never = known.where(F.col("old.score") >= FUZZY_AT).select("s")
    # only what is closer than the best stored row counts
    marked = strings.join(known, "s", "left").join(low, "s", "left").select("s", F.coalesce("old.score", "mark", F.lit(float(FUZZY_AT))).alias("mark"))
    options = cut(strings.join(never, "s", "left_anti"))
    # most strings have one mark, so each two of them meet once
    other = cut(marked.where(F.col("mark") != FUZZY_AT).unionByName(marked.join(never, "s", "left_semi").where(F.col("mark") == FUZZY_AT)))
    pairs = cut(fuzzy_join(options, None, FUZZY_AT))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    among = reaching(other, options).unionByName(both.join(other.select(F.col("s").alias("a")), "a", "left_anti"))
    own = options.select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit(100.0).alias("score"))
    among = cut(among.unionByName(own))
    # only best matches short of FUZZY_AT are compared word by word
    told = existing.join(known.where(F.col("old.score") < FUZZY_AT).select(F.col("old.other").alias("old_id")).dropDuplicates(), "old_id", "left_semi")
    close = low.select("s").unionByName(among.join(low.select(F.col("s").alias("a")), "a", "left_semi").select(F.col("b").alias("s")))
    asked = batch.join(rows.join(close, "s", "left_semi"), "new_id", "left_semi")
    words = cut(asked.select(F.col("new_id").alias("id"), "description").unionByName(told.select(F.col("old_id").alias("id"), "description")).select("id", tokenize(F.col("description")).alias("w")))
    none = F.lit(None)
    done = rows.limit(0).select("new_id", F.lit("").alias("decision"), none.cast("string").alias("canonical_id"), none.cast("double").alias("match_score"))
    left = rows.select("new_id", "seq", "s")
    accepted: DataFrame | None = None
    while left.limit(1).count():
        undecided = left.groupBy(F.col("s").alias("b")).agg(F.min("seq").alias("u"))
        firsts = undecided.withColumn("c", none.cast(T.StructType([T.StructField("seq", rows.schema["seq"].dataType), T.StructField("new_id", T.StringType())])))
        if accepted is not None:
            firsts = undecided.join(accepted, "b", "full_outer")
        met = left.withColumnRenamed("s", "a").join(among, "a").join(firsts, "b")
        waits = (F.col("u") < F.col("seq")) & (F.col("c").isNull() | (F.col("u") < F.col("c.seq")))
        option = F.when(waits, F.struct(none.cast("string").alias("other"), F.col("u").alias("place"))).when(F.col("c.seq") < F.col("seq"), F.struct(F.col("c.new_id").alias("other"), F.col("c.seq").alias("place")))
        new = met.withColumn("x", option).where("x IS NOT NULL").groupBy("new_id").agg(F.max_by(F.struct("x.other", "score"), F.struct("score", F.negate(F.col("x.place")))).alias("new"))
        top = left.join(new, "new_id", "left").join(known, "s", "left")
        stored = F.col("old").isNotNull() & (F.col("new").isNull() | (F.col("old.score") >= F.col("new.score")))
        ready = top.where(stored | F.col("new").isNull() | F.col("new.other").isNotNull()).select("new_id", "seq", "s", F.when(stored, F.col("old")).otherwise(F.col("new")).alias("m")).select("new_id", "seq", "s", "m.other", "m.score")
        told = ready.join(words.select(F.col("id").alias("new_id"), F.col("w").alias("wn")), "new_id", "left").join(words.select(F.col("id").alias("other"), F.col("w").alias("wo")), "other", "left")
        shared = jaccard(F.col("wn"), F.col("wo"))
        kind = F.when(F.col("score") >= FUZZY_AT, "fuzzy_title_company").when(F.col("other").isNotNull() & (shared >= SHARED_WORDS), "description_similarity").otherwise("canonical")
        decided = cut(told.select("new_id", "seq", "s", kind.alias("decision"), F.when(kind != "canonical", F.col("other")).alias("canonical_id"), F.when(kind == "fuzzy_title_company", F.bround(F.col("score") / 100, 4)).when(kind == "description_similarity", shared).alias("match_score")))
        done = cut(done.unionByName(decided.select("new_id", "decision", "canonical_id", "match_score")))
        fresh = decided.where("decision = 'canonical'").select(F.col("s").alias("b"), F.struct("seq", "new_id").alias("c"))
        accepted = cut((fresh if accepted is None else accepted.unionByName(fresh)).groupBy("b").agg(F.min("c").alias("c")))
        left = cut(left.join(decided.select("new_id"), "new_id", "left_anti"))
    return done.unionByName(within)


def dedup_window(jobs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Canonical jobs fetched within ``days`` before ``as_of``."""
    return jobs.where(F.col("duplicate_of").isNull() & (F.col("fetched_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))))
