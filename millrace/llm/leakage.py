"""Problem 8: passages of evaluation items inside corpus documents.

The items form a BM25 inverted index with block maxima. Every document is cut
into overlapping passages, every passage is a query, and block-max WAND
returns all items above the threshold; hits are then verified word by word.

The threshold loses nothing. A term's weight in an item is divided by the
least total weight of any run of RUN consecutive words of that item, so a
passage that holds such a run scores at least 1. Passages overlap by RUN - 1
words, so every run of a document lies inside one of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
RUN = 12
#: Words of a passage; two runs long, so that little beside a run adds to its score.
PASSAGE = 2 * RUN
K1, B = 1.2, 0.75
BLOCK = 16
#: Items sent to every task at once, about; a longer list is cut into slices of this size, each of which reads the corpus once more. Their block maxima and columns take about 100 MB.
ITEMS_AT_ONCE = 10_000
#: The threshold, with room for rounding of sums of float32.
NEED = 1.0 - 1e-4
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits in lower case."""
    return WORD.findall(text.lower()) if text else []


class ItemIndex:
    """BM25 postings of the items, scaled so that 1 is the threshold. ``counts``: corpus documents that hold each word, of ``total``."""

    def __init__(self, items: list[tuple[int, list[str]]], counts: dict[str, int], total: int):
        self.items = sorted((i, w) for i, w in items if len(w) >= RUN)
        n = len(self.items)
        mean = sum(len(w) for _, w in self.items) / n if n else 1.0
        idf = {t: math.log(1 + (total - c + 0.5) / (c + 0.5)) for t in {t for _, w in self.items for t in w} for c in (min(counts.get(t, 0), total),)}
        weights: list[dict[str, float]] = []
        runs: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for at, (_, w) in enumerate(self.items):
            tf = Counter(w)
            weight = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            windows = {tuple(w[k : k + RUN]) for k in range(len(w) - RUN + 1)}
            least = min(sum(weight[t] for t in set(run)) for run in windows)
            weights.append({t: x / least for t, x in weight.items()})
            for run in windows:
                runs[run].append(at)
        self.runs = dict(runs)
        self.term = {t: k for k, t in enumerate({t: None for x in weights for t in x})}
        # blocks of neighbouring item numbers, the same for all lists, so that the live blocks of a query are found at once;
        # a block holds the postings of its own terms only
        self.blocks: list[np.ndarray] = []
        self.block_most = np.zeros((-(-n // BLOCK), len(self.term) + 1), dtype=np.float32)
        # where a term's weights stand in its block; terms that a block doesn't hold point to a column of zeros
        self.column = np.zeros(self.block_most.shape, dtype=np.int32)
        for first in range(0, n, BLOCK):
            own = weights[first : first + BLOCK]
            terms = np.array(sorted({self.term[t] for x in own for t in x}))
            held = np.zeros((len(own), len(terms) + 1), dtype=np.float32)
            for row, x in enumerate(own):
                held[row, np.searchsorted(terms, [self.term[t] for t in x])] = list(x.values())
            self.blocks.append(held)
            self.block_most[first // BLOCK, terms] = held[:, :-1].max(axis=0)
            self.column[first // BLOCK] = len(terms)
            self.column[first // BLOCK, terms] = np.arange(len(terms))
        self.most = self.block_most.max(axis=0).astype(np.float64) if n else np.zeros(1)

    def search(self, terms: np.ndarray) -> list[int]:
        """All items that score at least 1 for the distinct ``terms``.

        Block-max WAND with blocks of item numbers: the lists' maxima rule out the
        query, the blocks' maxima rule out blocks, and only items of live blocks
        are scored.
        """
        if self.most[terms].sum() < NEED:
            return []
        live = np.flatnonzero(self.block_most[:, terms].sum(axis=1) >= NEED)
        found: list[int] = []
        for block in live.tolist():
            scores = self.blocks[block][:, self.column[block, terms]].sum(axis=1)
            found.extend((block * BLOCK + np.flatnonzero(scores >= NEED)).tolist())
        return found

    def leaks(self, tokens: list[str], codes: np.ndarray) -> dict[int, int]:
        """item position -> words of the document inside runs that the item has; only items that WAND retrieved."""
        n = len(tokens)
        if n < RUN:
            return {}
        upper = np.concatenate([[0.0], np.cumsum(self.most[codes])])
        starts = np.arange(0, max(1, n - RUN + 1), PASSAGE - RUN + 1)
        ends = np.minimum(starts + PASSAGE, n)
        out: dict[int, set[int]] = defaultdict(set)
        for k in np.flatnonzero(upper[ends] - upper[starts] >= NEED):
            s, e = int(starts[k]), int(ends[k])
            hits = set(self.search(np.array(sorted(set(codes[s:e].tolist())))))
            if not hits:
                continue
            for p in range(s, e - RUN + 1):
                got = self.runs.get(tuple(tokens[p : p + RUN]))
                if got:
                    for i in hits.intersection(got):
                        out[i].update(range(p, p + RUN))
        return {i: len(at) for i, at in out.items()}


def corpus_counts(documents: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How many of all documents hold each word of the items, and the number of documents."""
    order = sorted(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total, known = Counter(), 0, frozenset(order)
        for pdf in batches:
            total += len(pdf)
            for text in pdf["text"]:
                own.update(known.intersection(WORD.findall(text.lower())))
        yield pd.DataFrame({"w": [*own, ""], "n": [*own.values(), total]})

    rows = documents.where(F.col("text").isNotNull()).select("text").mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {r.w: r.n for r in rows}
    return counts, counts.pop("", 0)


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared_words, question_share, answer_found) for every document that holds RUN consecutive words of an item's passage.

    question_share is the part of the question's distinct words found in the
    document, answer_found whether the answer stands in it as consecutive words.
    Null or short texts and passages leak nothing; repeated doc_ids are counted
    once with their largest figures; an empty table on either side gives no rows.
    One scan counts the words of all items, another searches up to ITEMS_AT_ONCE
    of them; no shuffle but the final one over the few hits.
    """
    known = items.select("item_id", "passage", "question", "answer").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull())
    many = max(1, math.ceil(known.count() / ITEMS_AT_ONCE))
    slices = [known.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k) for k in range(many)]
    schema = "doc_id long, item_id long, shared_words int, question_share double, answer_found boolean"
    lists = [[tuple(r) for r in part.collect()] for part in slices]
    every, total = corpus_counts(documents, {t for rows in lists for _, p, _, _ in rows for t in words(p)})
    out = None
    for rows in lists:
        counts = {t: every[t] for _, p, _, _ in rows for t in words(p) if t in every}

        def run(batches: Iterator[pd.DataFrame], rows=rows, counts=counts, total=total) -> Iterator[pd.DataFrame]:
            index = ItemIndex([(i, words(p)) for i, p, _, _ in rows], counts, total)
            asked = {i: (set(words(q)), " ".join(words(a))) for i, _, q, a in rows}
            nothing, term = len(index.term), index.term
            for pdf in batches:
                hits = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    tokens = words(text)
                    codes = np.fromiter((term.get(t, nothing) for t in tokens), dtype=np.int64, count=len(tokens))
                    for at, shared in index.leaks(tokens, codes).items():
                        item = index.items[at][0]
                        question, answer = asked[item]
                        own = set(tokens)
                        hits.append((doc, item, shared, len(question & own) / len(question) if question else 0.0, bool(answer) and f" {answer} " in f" {' '.join(tokens)} "))
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "shared_words", "question_share", "answer_found"])

        found = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("shared_words").alias("shared_words"), F.max("question_share").alias("question_share"), F.max("answer_found").alias("answer_found"))
