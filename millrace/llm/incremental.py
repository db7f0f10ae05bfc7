"""Problem 6: new batches checked against everything accepted before.

Every accepted posting leaves hashes in a table bucketed by them: of its page
(canonical url), of its whole normalised content (title and company), of three
paragraphs of it (the title with each third of the company; two edits leave a
third whole, at most two letters from its place), and, for each title word that
is too rare to be in the vocabulary, of the content without that word. The
hash alone is the key of the join, so new rows meet the table bucket by bucket
and the table itself is never moved; kind, company and word are compared after
that. A shared page or whole content is a full copy, a shared paragraph is a
near copy if the companies are at most two edits apart (one slip in names of
three or four letters), content that shares all but a rare word is a near copy
if that word is unknown to the history and a slip of the word held there. Then
the hashes of the accepted rows are appended.

A history has a name and outlives a call: postings are read once, when it is
built, and later calls read its tables alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.reference_match import reach
from millrace.llm.trie import Trie
from millrace.session import cut, forget, shared_folder

#: A title word is in the vocabulary if at least one row in RARE_SHARE of those a history is built from holds it; of those the VOCABULARY most frequent ones. All other words are matched by the hashes without them.
RARE_SHARE, VOCABULARY = 3_000, 100_000
COMPANY_EDITS = 2
#: Cores from this length on may be COMPANY_EDITS apart, shorter ones a slip (one edit or a swap of neighbours), those below three letters nothing.
TWO_EDITS_FROM = 5
PAGE, CONTENT, NEAR, RARE = 0, 1, 2, 3
# Abbreviations of title words.
ABBREVIATIONS = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "princ": "principal", "prin": "principal", "eng": "engineer", "engr": "engineer", "dev": "developer",
    "anlst": "analyst", "sci": "scientist", "ml": "machine learning", "ai": "artificial intelligence", "mgr": "manager", "assoc": "associate", "spec": "specialist", "dl": "deep learning", "cv": "computer vision",
}
# Title words on urgency, mode of work and the like.
REMARKS = frozenset("urgent urgently asap new now hiring immediate immediately start hybrid remote onsite site on full part time fulltime parttime contract permanent temporary temp m f x d w h mfd wfh home office reposted repost featured hot".split())
# Words of company forms.
FORMS = frozenset("inc incorporated ltd ltee limited llc llp corp corporation co company group holdings holding plc canada gmbh sa the".split())
TRACKING = r"^(?:utm_\w+|refid|ref|trk|trackingid|from|src|source|gclid|fbclid|campaign|medium)$"


def canonical_page(url: Column) -> Column:
    """A url without scheme, www, letter case of the host, fragment, tracking parameters and closing slash; null if blank."""
    text = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:www\.)?|#.*$", "")
    host = F.lower(F.regexp_extract(text, r"^([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(text, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(text, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike(TRACKING))), "&")
    return F.when(F.length(F.trim(text)) > 0, F.concat_ws("?", F.concat(F.regexp_replace(host, r"^www\.|:\d+$", ""), path), F.when(query != "", query)))


def company_core(company: Column) -> Column:
    """Company words without those of its form, run together."""
    words = F.filter(F.split(F.lower(company), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*sorted(FORMS)))
    core = F.array_join(words, "")
    return F.when(core != "", core).otherwise(F.regexp_replace(F.lower(company), r"[^\p{L}\p{N}]+", ""))


def title_words(rows: DataFrame) -> DataFrame:
    """(w, n): the words of ``title_normalized`` and how many rows hold them."""
    words = rows.select(F.explode(F.array_distinct(F.split(F.lower("title_normalized"), r"\s+"))).alias("w"))
    return words.where("w != ''").groupBy("w").agg(F.count("*").alias("n"))


class TitleReader:
    """A title as its sorted words: abbreviations written out, remarks dropped, misspelt words mended with the trie."""

    def __init__(self, vocabulary: dict[str, int]):
        self.counts = vocabulary
        for word in [*REMARKS, *(w for full in ABBREVIATIONS.values() for w in full.split())]:
            self.counts.setdefault(word, 1)
        self.trie = Trie((w, w) for w in self.counts if len(w) > 3 and w not in ABBREVIATIONS)
        self.seen: dict[str, tuple[str, ...]] = {}

    def word(self, word: str) -> tuple[str, ...]:
        """The words meant by one written word."""
        got = self.seen.get(word)
        if got is None:
            got = self._word(word)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def _word(self, word: str) -> tuple[str, ...]:
        if word in ABBREVIATIONS:
            return tuple(ABBREVIATIONS[word].split())
        own = self.counts.get(word, 0)
        near = [(d, -self.counts[w], w) for d, w, _ in self.trie.search(word, 2) if 0 < d <= reach(len(w)) and self.counts[w] >= 50 * max(own, 0 if own == 0 else 1)]
        if own and not (near and min(near)[0] == 1):
            return (word,)
        if near and (not own or min(near)[0] == 1):
            return (min(near)[2],)
        if len(word) == 1:
            return ()
        for cut_at in range(3, len(word) - 2):
            parts = word[:cut_at], word[cut_at:]
            if all(p in self.counts for p in parts):
                return parts
        return (word,)

    def key(self, title: str) -> tuple[str, list[str], list[str]]:
        """The title's words, sorted (empty if nothing but remarks is left), its words that aren't in the vocabulary, and what is left without each of these."""
        words = sorted(w for t in title.lower().split() for w in self.word(t) if w not in REMARKS)
        rare = [k for k, w in enumerate(words) if w not in self.counts and len(w) > 3 and (k == 0 or words[k - 1] != w)]
        return " ".join(words), [words[k] for k in rare], [" ".join(words[:k] + words[k + 1 :]) for k in rare]


def read_keys(rows: DataFrame, keep: list[str], vocabulary: dict[str, int]) -> DataFrame:
    """``keep`` and ``page``, ``title_key``, ``core`` of each row, null where there is none, its stored and asked paragraph hashes ``parts`` and ``asks``, and ``rare`` (word, h): the hashes of its content without a rare word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TitleReader(dict(vocabulary))
        for pdf in batches:
            codes, titles = pd.factorize(pdf["title_normalized"])
            keys = [reader.key(t) for t in titles]
            for i, column in enumerate(("title_normalized", "_words", "_rests")):
                pdf[column] = pd.Series([keys[c][i] if c >= 0 else None for c in codes], index=pdf.index, dtype=object)
            yield pdf

    staged = rows.select(*keep, canonical_page(F.col("url")).alias("page"), company_core(F.col("company_normalized")).alias("core"), "title_normalized")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema.fields) + ", _words array<string>, _rests array<string>"
    read = staged.mapInPandas(run, schema)
    keyed = read.select(*keep, "page", F.when(F.col("title_normalized") != "", F.col("title_normalized")).alias("title_key"), F.when(F.col("core") != "", F.col("core")).alias("core"), "_words", "_rests")
    t, c = F.col("title_key"), F.col("core")
    none = F.array().cast("array<struct<word: string, h: bigint>>")
    rare = F.when(c.isNotNull() & (F.size("_words") > 0), F.zip_with("_words", "_rests", lambda w, r: F.struct(w.alias("word"), F.xxhash64(F.lit("rare"), r, c).alias("h"))))
    return keyed.select(*keep, "page", "title_key", "core", stored_parts(t, c).alias("parts"), asked_parts(t, c).alias("asks"), F.coalesce(rare, none).alias("rare"))


def _third(length: Column, i: int) -> tuple[Column, Column]:
    """(start, length) of the i-th third (1 to 3) of a core of this length; later thirds are the longer ones."""
    q, rest = F.floor(length / 3).cast("int"), length % 3
    second = q + (rest == 2).cast("int")
    third = q + (rest >= 1).cast("int")
    return [(F.lit(1), q), (q + 1, second), (length - third + 1, third)][i - 1]


def _part(title: Column, core: Column, length: Column, i: int, shift: int) -> Column:
    """Hash of the piece of ``core`` that stands ``shift`` letters from where a core of ``length`` has its i-th third; null where there is none."""
    start, size = _third(length, i)
    start = start + shift
    return F.when(title.isNotNull() & (length >= 3) & (start >= 1) & (start + size - 1 <= F.length(core)), F.xxhash64(F.lit("part"), title, length, F.lit(i), F.substring(core, start, size)))


def stored_parts(title: Column, core: Column) -> Column:
    """The three paragraph hashes of a title and company; none for a core below three letters."""
    return F.array_compact(F.array(*[_part(title, core, F.length(core), i, 0) for i in (1, 2, 3)]))


def asked_parts(title: Column, core: Column) -> Column:
    """All paragraph hashes that some core at most two edits away has stored.

    Of two edits, at least one third of the other core has none. The first that
    is whole has at most one edit a third before it and as few behind it, which
    bounds its shift: the selection of Pass-Join, complete for two edits.
    """
    found = []
    for longer in range(-COMPANY_EDITS, COMPANY_EDITS + 1):  # letters by which this core is longer than the other
        for i in (1, 2, 3):
            for shift in range(max(1 - i, longer - 3 + i), min(i - 1, longer + 3 - i) + 1):
                found.append(_part(title, core, F.length(core) - longer, i, shift))
    return F.array_compact(F.array(*found))


def near_cores(a: Column, b: Column) -> Column:
    """Are two cores the same but for slips?"""
    edits = F.levenshtein(a, b, COMPANY_EDITS)
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: b == F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))
    short = F.least(F.length(a), F.length(b))
    return F.when(short >= TWO_EDITS_FROM, edits >= 0).when(short >= 3, edits.isin(0, 1) | ((edits == 2) & swapped)).otherwise(a == b)


def whole(title: str, core: str) -> Column:
    """Hash of the whole content; null where a part of it is."""
    return F.when(F.col(title).isNotNull() & F.col(core).isNotNull(), F.xxhash64(F.lit("all"), title, core))


def hashes(page: str, title: str, core: str) -> Column:
    """The array of (kind, h, core, word) a posting with its ``parts`` and ``rare`` leaves; what is null leaves none."""
    c, none = F.col(core), F.lit(None).cast("string")
    one = lambda kind, h, own, word: F.struct(F.lit(kind).alias("kind"), h.alias("h"), own.alias("core"), word.alias("word"))
    full = [F.when(F.col(page).isNotNull(), one(PAGE, F.xxhash64(F.lit("page"), page), none, none)), F.when(whole(title, core).isNotNull(), one(CONTENT, whole(title, core), none, none))]
    return F.concat(F.array_compact(F.array(*full)), F.transform("parts", lambda h: one(NEAR, h, c, none)), F.transform("rare", lambda x: one(RARE, x["h"], none, x["word"])))


def slipped(a: Column, b: Column) -> Column:
    """Are two words the same but for slips, by the reach of the shorter one (two edits at most)?"""
    short = F.least(F.length(a), F.length(b))
    return F.levenshtein(a, b, 2).between(1, F.when(short < 4, 0).when(short < 6, 1).otherwise(2))


class History:
    """The hashes and title words of all accepted postings, below the shared folder.

    A name that is known opens the history of that name, in this session or a
    later one. ``buckets`` is fixed when it is made; a bucket should be what a
    task can sort.
    """

    COLUMNS = "h BIGINT, kind INT, core STRING, word STRING, rank STRING, job_id STRING"

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 24):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"accepted_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet CLUSTERED BY (h) INTO {buckets} BUCKETS LOCATION '{self.path}/hashes'")

    def build(self, jobs: DataFrame) -> History:
        """Fill an empty history with accepted postings (job_id, url, title_normalized, company_normalized, duplicate_of, fetched_at)."""
        words = cut(title_words(jobs))
        words.write.mode("overwrite").parquet(f"{self.path}/words")
        least = max(3, jobs.count() / RARE_SHARE)
        words.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(VOCABULARY).write.mode("overwrite").parquet(f"{self.path}/vocabulary")
        # the posting that stands for equal ones: one that is no known duplicate, then the first fetched, then the smaller id
        rank = F.concat_ws("|", F.when(F.col("duplicate_of").isNull(), "0").otherwise("1"), F.date_format("fetched_at", "yyyyMMddHHmmss"), F.col("job_id"))
        self.append(read_keys(jobs.withColumn("rank", rank).where(F.col("job_id").isNotNull()), ["job_id", "rank"], self.vocabulary()))
        return self

    def vocabulary(self) -> dict[str, int]:
        """The frequent title words, VOCABULARY at most."""
        return {r.w: r.n for r in self.spark.read.schema("w string, n long").parquet(f"{self.path}/vocabulary").collect()}

    def words(self) -> DataFrame:
        """(w, n) of all accepted titles; a word may stand in several rows."""
        return self.spark.read.schema("w string, n long").parquet(f"{self.path}/words")

    def append(self, postings: DataFrame) -> None:
        """Add postings (job_id, rank, page, title_key, core, parts, rare): of equal hashes the lowest rank owns."""
        rows = postings.select("job_id", "rank", F.explode(hashes("page", "title_key", "core")).alias("x")).select("job_id", "rank", "x.*")
        owned = rows.groupBy("h", "kind", "core", "word").agg(F.min(F.struct("rank", "job_id")).alias("owner"))
        flat = owned.select("h", "kind", "core", "word", F.col("owner.rank").alias("rank"), F.col("owner.job_id").alias("job_id"))
        flat.repartition(self.buckets, "h").write.insertInto(self.name)

    def accept(self, keyed: DataFrame, titles: DataFrame) -> None:
        """Add accepted arrivals (as of read_keys, with arrival_id) and the words of their titles (title_normalized)."""
        self.append(keyed.withColumn("rank", F.concat_ws("|", F.lit("2"), F.lpad(F.col("arrival_id").cast("string"), 20, "0"))))
        title_words(titles).write.mode("append").parquet(f"{self.path}/words")

    def table(self) -> DataFrame:
        """The hash table."""
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the history and remove its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        forget(self.spark, self.path)

    def met(self, batch: DataFrame) -> DataFrame:
        """(kind, asked, h, core, word, core2, word2, rank, job_id): the hashes of ``batch`` that the table holds, joined on the hash alone so that its buckets stay where they are."""
        one = lambda kind, h: F.when(h.isNotNull(), F.struct(F.lit(kind).alias("kind"), h.alias("asked")))
        page = F.when(F.col("page").isNotNull(), F.xxhash64(F.lit("page"), "page"))
        content, none = whole("title_key", "core"), F.lit(None).cast("string")
        # each hash meets the table once, however many rows of the batch share it; the way back to the rows is a join that can be split
        once = batch.select(F.explode(F.array_compact(F.array(one(PAGE, page), one(CONTENT, content)))).alias("x")).select("x.*").dropDuplicates().select("kind", "asked", F.col("asked").alias("h"), none.alias("core"), none.alias("word"))
        names = batch.where(content.isNotNull()).select(content.alias("asked"), "core", "asks", "rare").dropDuplicates(["asked"])
        parts = names.select(F.lit(NEAR).alias("kind"), "asked", F.explode("asks").alias("h"), "core", none.alias("word"))
        rare = names.select("asked", F.explode("rare").alias("x")).select(F.lit(RARE).alias("kind"), "asked", F.col("x.h").alias("h"), none.alias("core"), F.col("x.word").alias("word"))
        held = self.table().select("h", F.col("kind").alias("kind2"), F.col("core").alias("core2"), F.col("word").alias("word2"), "rank", "job_id")
        # written so, kind does not become a second key of the join, beside which the buckets would be of no use
        return once.union(parts).union(rare).join(held, "h").where("kind - kind2 = 0").drop("kind2")

    def matches(self, batch: DataFrame) -> DataFrame:
        """(arrival_id, job_id, coverage) of the batch rows that repeat an accepted posting: a page first, then whole content, then near content.

        coverage is the share of the three paragraphs that both hold, 1 for full copies.
        """
        near = F.when(F.col("kind") == NEAR, near_cores(F.col("core"), F.col("core2"))).when(F.col("kind") == RARE, slipped(F.col("word"), F.col("word2"))).otherwise(True)
        met = cut(self.met(batch).where(near))
        # a word that the history knows is no slip
        known = self.words().select(F.col("w").alias("word")).join(met.where(F.col("kind") == RARE).select("word").dropDuplicates(), "word", "left_semi").dropDuplicates()
        met = met.join(known.withColumn("_known", F.lit(True)), "word", "left").where("_known IS NULL OR word IS NULL")
        edits = F.when(F.col("kind") == NEAR, F.levenshtein("core", "core2")).when(F.col("kind") == RARE, F.levenshtein("word", "word2")).otherwise(0)
        each = met.groupBy("kind", "asked", "core2", "word2").agg(F.min(edits).alias("edits"), F.when(F.col("kind") == NEAR, F.count_distinct("h") / 3).otherwise(F.lit(1.0)).alias("coverage"), F.min(F.struct("rank", "job_id")).alias("owner"))
        told = each.groupBy("kind", "asked").agg(F.min(F.struct("edits", (-F.col("coverage")).alias("less"), "owner")).alias("m"))
        # the lowest kind, then the fewest edits
        best = lambda kinds, key: told.where(F.col("kind").isin(*kinds)).groupBy(F.col("asked").alias(key)).agg(F.min(F.struct("kind", "m")).alias(f"_{key}"))
        rows = batch.select("arrival_id", F.xxhash64(F.lit("page"), "page").alias("pk"), whole("title_key", "core").alias("ck")).join(best((PAGE,), "pk"), "pk", "left").join(best((CONTENT, NEAR, RARE), "ck"), "ck", "left")
        found = F.coalesce("_pk", "_ck")
        return rows.where(found.isNotNull()).select("arrival_id", found["m"]["owner"]["job_id"].alias("job_id"), F.negate(found["m"]["less"]).alias("coverage"))


def same_core(rows: DataFrame) -> DataFrame:
    """``rows`` with ``content``: one hash for rows of one title whose companies are near each other.

    Contents are compared once each, over the same paragraph hashes, in the
    order of their first arrival: one that is near an earlier one that stands
    for itself takes its hash, any other stands for itself. A content is
    decided as soon as all earlier ones near it are, all such at once, so only
    chains of near names take further rounds.
    """
    rows = rows.withColumn("_whole", whole("title_key", "core"))
    names = rows.where(F.col("_whole").isNotNull()).groupBy("_whole").agg(F.min("arrival_id").alias("since"), *[F.any_value(k).alias(k) for k in ("core", "parts", "asks")])
    asked = names.select(F.col("_whole").alias("a"), "since", "core", F.explode("asks").alias("part"))
    other = names.select(F.explode("parts").alias("part"), F.col("_whole").alias("b"), F.col("since").alias("since2"), F.col("core").alias("core2"))
    edges = cut(asked.join(other, "part").where((F.col("since2") < F.col("since")) & near_cores(F.col("core"), F.col("core2"))).select("a", "b", "since2").dropDuplicates())
    left = cut(edges.select("a").dropDuplicates())
    repeats: DataFrame | None = None
    while left.limit(1).count():
        waiting = edges.join(left.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        ready = cut(left.join(waiting, "a", "left_anti"))
        standing = edges.join(ready, "a", "left_semi")
        if repeats is not None:
            standing = standing.join(repeats.select(F.col("a").alias("b")), "b", "left_anti")
        told = standing.groupBy("a").agg(F.min(F.struct("since2", "b")).alias("m")).select("a", F.col("m.b").alias("content"))
        repeats = cut(told if repeats is None else repeats.unionByName(told))
        left = cut(left.join(ready, "a", "left_anti"))
    if repeats is None:
        return rows.withColumnRenamed("_whole", "content")
    return rows.join(repeats.withColumnRenamed("a", "_whole"), "_whole", "left").withColumn("content", F.coalesce("content", "_whole")).drop("_whole")


def settle(fresh: DataFrame) -> DataFrame:
    """Which rows that repeat nothing in the history repeat an earlier row of their own batch.

    ``fresh``: arrival_id, job_id, page, title_key, core, parts, asks. Gives arrival_id,
    job_id, owner (null for an accepted row). A row that comes first in both its
    page and its content is accepted; whatever shares either with it later is a
    repeat; what is left goes round again. Only two minima per key are taken, so
    a group of any size is combined before it is shuffled.
    """
    left = cut(same_core(fresh).select("arrival_id", "job_id", F.xxhash64("page").alias("pk"), F.col("page").isNull().alias("nopage"), "content"))
    # rows without a page or content are alone in that key
    left = left.select("arrival_id", "job_id", F.when(F.col("nopage"), F.xxhash64(F.lit("p"), "arrival_id")).otherwise(F.col("pk")).alias("pk"), F.coalesce("content", F.xxhash64(F.lit("c"), "arrival_id")).alias("ck"))
    done: list[DataFrame] = []
    while True:
        firsts = [left.groupBy(k).agg(F.min(F.struct("arrival_id", "job_id")).alias(f"{k}_first")) for k in ("pk", "ck")]
        seen = cut(left.join(firsts[0], "pk").join(firsts[1], "ck"))
        own = F.col("arrival_id")
        accepted = seen.where((F.col("pk_first.arrival_id") == own) & (F.col("ck_first.arrival_id") == own)).select("arrival_id", "job_id", "pk", "ck")
        done.append(accepted.select("arrival_id", "job_id", F.lit(None).cast("string").alias("owner")))
        sure = accepted.select(F.col("arrival_id").alias("sure"))
        by_page = seen.join(sure, F.col("pk_first.arrival_id") == F.col("sure"), "left").withColumn("by_page", F.when(F.col("sure").isNotNull(), F.col("pk_first.job_id"))).drop("sure")
        both = cut(by_page.join(sure, F.col("ck_first.arrival_id") == F.col("sure"), "left").withColumn("by_content", F.when(F.col("sure").isNotNull(), F.col("ck_first.job_id"))).drop("sure"))
        mine = (F.col("pk_first.arrival_id") == own) & (F.col("ck_first.arrival_id") == own)
        repeats = both.where(~mine & F.coalesce("by_page", "by_content").isNotNull())
        done.append(repeats.select("arrival_id", "job_id", F.coalesce("by_page", "by_content").alias("owner")))
        left = both.where(~mine & F.coalesce("by_page", "by_content").isNull()).select("arrival_id", "job_id", "pk", "ck")
        if left.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done)


def check(history: History, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arrival_id, job_id) of the rows that repeat an accepted posting, and the rows to be accepted, with their keys.

    Rows come in order of arrival_id, along which batches never fall, so any
    number of batches is one pass: first against the history, then what is left
    among itself.
    """
    arrived = cut(read_keys(incoming.where(F.col("arrival_id").isNotNull()).dropDuplicates(["arrival_id"]), ["arrival_id", "job_id"], history.vocabulary()))
    known = cut(history.matches(arrived).select("arrival_id", "job_id"))
    fresh = arrived.join(known.select("arrival_id"), "arrival_id", "left_anti")
    settled = cut(settle(fresh))
    repeats = known.unionByName(settled.where("owner IS NOT NULL").select("arrival_id", F.col("owner").alias("job_id")))
    return repeats, fresh.join(settled.where("owner IS NULL").select("arrival_id"), "arrival_id", "left_semi")


def check_and_append(history: History, incoming: DataFrame) -> DataFrame:
    """(arrival_id, job_id) of the rows that repeat an accepted posting; the hashes of all others are added to the history."""
    repeats, accepted = check(history, incoming)
    accepted = cut(accepted)
    history.accept(accepted, incoming.join(accepted.select("arrival_id").dropDuplicates(), "arrival_id", "left_semi").dropDuplicates(["arrival_id"]))
    return repeats


def check_batches(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """(arrival_id, job_id) for each incoming row that repeats an accepted posting, with that posting's job_id.

    All of ``jobs`` counts as accepted. Null or blank urls, titles and companies
    match nothing. Rows that repeat an arrival_id count once. An empty batch or
    history gives no rows. The history made for this call is removed after it;
    ``History.build`` and ``check_and_append`` keep one.
    """
    history = History(jobs.sparkSession).build(jobs)
    found = cut(check_and_append(history, incoming))
    history.drop()
    return found
