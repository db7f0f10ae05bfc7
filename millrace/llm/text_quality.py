"""Problem 9: per-document text statistics and a Gaussian mixture over them.

Each document gets a vector of statistics. A Gaussian mixture is fitted to the
standardised vectors of all documents by expectation-maximization (one pass a
round, only sufficient statistics leave a task), and its components are named
prose, list, table or junk by the inspected examples below, from which they
are also seeded. The components decide; only where a component straddles
prose and the rest are its documents settled by their share of sentences.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

# Frequent function words of English and French that mark running text.
COMMON = frozenset(
    "the of and to in is that it for was on are as with they at be this from have or by one had not but what all were when we there can an your which their if do will how about "
    "up out them then she many some so these would other into has more her two like him see could no than been its who now did get come made may i you a he his my our us because although once yet only most where while whoever nobody several after before without rarely ever often each every any between "
    "le la les un une des du de et en est que qui dans pour sur pas plus par avec nous vous ils elle sont au aux ce cette ou mais si leur son sa ses votre notre nos vos être avoir".split()
)
STATISTICS = ("log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "closed_line_share", "common_share", "upper_share", "words_per_line", "marked_line_share", "sentence_share")
#: Components seeded for each kind.
COMPONENTS = {"prose": 3, "list": 2, "table": 2, "junk": 3}
#: The fit ends when the mean log-likelihood rises by less than this share of itself; a fit that hasn't ended after STUCK rounds is an error.
TOLERANCE, STUCK = 1e-4, 1_000
#: Rows that seed the components; every row takes part in the fit.
SEED_ROWS = 2_000
#: Least variance of a component along each statistic, in standard deviations squared.
RIDGE = 0.02
KINDS = tuple(COMPONENTS)
#: A component is clear if its share of sentences lies this many of its own standard deviations on its kind's side of one half.
CLEAR = 2.0
#: Probability of clear components from which they decide about a document.
SURE = 0.9

SENTENCE_END = re.compile(r"[.!?…]+[\"'»”’)\]]*(?=\s|$)")
SYMBOL = re.compile(r"[^\w\s]")
BULLETS = "-*•·–▪◦#"


def _marked(line: str) -> bool:
    """Whether a line is set off as a bullet, heading, table row or link."""
    return line.lstrip()[:1] in BULLETS or "|" in line or "\t" in line or ";" in line or "★" in line or "://" in line or line.count(",") - line.count(", ") > 2


def _worded(tokens: list[str], share: int) -> bool:
    """Whether at least one in ``share`` tokens is another common word, and most are plain words."""
    lower = [t.lower() for t in tokens]
    return len(COMMON.intersection(lower)) * share >= min(len(tokens), 40) and sum(map(str.isalpha, lower)) * 2 >= len(tokens)


def _runs_on(line: str) -> bool:
    """Whether a line without a sentence end looks like part of running text."""
    tokens = line.split()
    if len(tokens) < 3 or _marked(line) and line.lstrip()[:1] not in "-*•" and "; " not in line:
        return False
    return _worded(tokens, 8)


def _is_sentence(text: str) -> bool:
    tokens = text.split()
    if len(tokens) < 3 or sum(map(str.islower, tokens)) * 2 < len(tokens):
        return False
    return _worded(tokens, 10)


def sentence_chars(text: str) -> int:
    """Characters that belong to full sentences, which may be wrapped over lines or set as bullets."""
    total, start = 0, 0
    for end in SENTENCE_END.finditer(text):
        chunk = text[start : end.end()]
        start = end.end()
        if "\n" not in chunk.strip():
            if _is_sentence(chunk):
                total += len(chunk)
            continue
        lines = chunk.rstrip().split("\n")
        k = len(lines) - 1
        while k > 0 and lines[k - 1].strip() and _runs_on(lines[k - 1]) and lines[k].lstrip()[:1] not in "-*•#":
            k -= 1
        body = "\n".join(lines[k:])
        if _is_sentence(body):
            total += len(body)
    return total


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS."""
    n = len(text)
    tokens = text.split()
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    n_tokens, n_lines = max(1, len(tokens)), max(1, len(lines))
    closed = sum(s.rstrip()[-1] in ".!?:…»”" for s in lines)
    return (
        float(np.log1p(len(tokens))),
        min(30.0, sum(map(len, tokens)) / n_tokens),
        len(SYMBOL.findall(text)) / max(1, n),
        sum(map(text.count, "0123456789")) / max(1, n),
        closed / n_lines,
        sum(map(COMMON.__contains__, text.lower().split())) / n_tokens,
        sum(map(str.isupper, [t[0] for t in tokens])) / n_tokens,
        float(np.log1p(len(tokens) / n_lines)),
        sum(map(_marked, lines)) / n_lines,
        sentence_chars(text) / max(1, n),
    )


# Inspected examples, written for this purpose, that name the components.
EXAMPLES = (
    ("prose", "The team meets on Mondays to plan the week. Everyone brings one question, and the lead writes down what was decided. Nobody is asked to stay late, although some do when a release is near."),
    ("prose", "We moved the reports to a new server because the old one was too slow. It took three weeks and two attempts. Now the numbers are ready before the first coffee is poured."),
    ("prose", "# Notes\nMost people who apply have read the advert only once. That is fine, but it helps to read it again before the call. You can then ask about the things that are not in it."),
    ("prose", "- You will help the analysts to find errors in the data.\n- You will write short notes that others can follow.\n- You will learn how the models are checked before they are used."),
    ("prose", "Nous cherchons une personne qui aime le travail en équipe. Le poste est basé dans notre bureau du centre. Vous présenterez les résultats à la direction chaque mois."),
    ("list", "- flexible hours\n- dental cover\n- transit passes\n- shared lunches\n- learning budget\n- home office\n- quiet rooms\n- parking"),
    ("list", "• Python\n• SQL\n• dashboards\n• version control\n• load tests\n• survey answers\n• notebooks\n• timesheets"),
    ("list", "flexible hours\ndental cover\nsurvey answers\nload tests\nnotebooks\nmentoring\nrelocation\ntransit passes\nledger entries"),
    ("table", "role | town | from | to\nAnalyst | Guelph | 60000 | 90000\nEngineer | Oshawa | 80000 | 120000\nScientist | Laval | 85000 | 130000\nDeveloper | Barrie | 70000 | 99000"),
    ("table", "role,town,from,to\nAnalyst,Guelph,60000,90000\nEngineer,Oshawa,80000,120000\nScientist,Laval,85000,130000\nDeveloper,Barrie,70000,99000"),
    ("table", "role\ttown\tfrom\tto\nAnalyst\tGuelph\t60000\t90000\nEngineer\tOshawa\t80000\t120000\nScientist\tLaval\t85000\t130000"),
    ("table", "Python: ★★★  physics: 4/10\nRust: ★  statistics: 7/10\nSQL: ★★★★  economics: 5/10\nScala: ★★  biology: 3/10"),
    ("junk", "2025-01-02 03:04:05 INFO fetch[12] status=200 rows=7\n2025-01-02 03:04:09 WARN fetch[13] status=429 rows=0\n2025-01-02 03:05:00 INFO fetch[14] status=200 rows=9"),
    ("junk", "https://example.org/a/b/123?page=1\nhttps://example.org/a/b/456?page=2\nhttps://example.org/a/b/789?page=3\nhttps://example.org/c/d/321?page=4"),
    ("junk", "jobs near me best jobs apply salary data jobs best apply vacancy near me jobs salary hiring best data scientist jobs apply hiring vacancy jobs best"),
    ("junk", "{}<>##%% ~~ ||==@@ \\x0 %%&& {}{} ==~~ ??<> @@## ||%% \\x\\x ~~&& <>{} ==##\n??%% ~~|| @@== {}## && <> \\x0x ||~~"),
    ("junk", "Home\nLogin\nHelp\nShare\nPrint\nCookies\nHome\nSign up\nAlerts\nPrivacy\nNext »\n« Back\nHelp\nHome"),
    ("list", "The office has more to offer than a desk.\n- flexible hours\n- dental cover\n- transit passes\n- shared lunches\n- learning budget\n- home office\n- quiet rooms\n- parking\n- load tests\n- notebooks\n- mentoring"),
    ("table", "These are the roles we saw in the spring.\nrole,town,from,to\nAnalyst,Guelph,60000,90000\nEngineer,Oshawa,80000,120000\nScientist,Laval,85000,130000\nDeveloper,Barrie,70000,99000\nAnalyst,Regina,61000,88000\nMost of them were filled."),
    ("table", "The skills of the group are set out below, and they will change.\nPython: ★★★  physics: 4/10\nRust: ★  statistics: 7/10\nSQL: ★★★★  economics: 5/10\nScala: ★★  biology: 3/10\nKotlin: ★★  history: 6/10\nJulia: ★  botany: 1/10\nGo: ★  music: 2/10"),
    ("junk", "A short note is better than a long one. DATA ENGINEER\nREMOTE DATA ENGINEER REMOTE REMOTE DATA ENGINEER APPLY DATA ENGINEER APPLY REMOTE DATA ENGINEER REMOTE DATA ENGINEER APPLY APPLY!!!\nNobody reads it twice."),
    ("junk", "A good answer takes time, and most people know it.\nHome\nLogin\nHelp\nShare\nPrint\nCookies\nHome\nSign up\nAlerts\nPrivacy\nNext »\n« Back\nHelp\nHome\nLogin\nShare\nCookies\nAlerts\nPrint\nHelp"),
    ("junk", "They met twice before the offer was made.\n{}<>##%% ~~ ||==@@ \\x0 %%&& {}{} ==~~ ??<> @@## ||%% \\x\\x ~~&& <>{} ==## {}<>##%% ~~ ||==@@ \\x0 %%&& {}{} ==~~ ??<> @@##"),
    ("junk", "DATA ENGINEER DATA ENGINEER REMOTE DATA ENGINEER REMOTE REMOTE DATA ENGINEER APPLY DATA ENGINEER APPLY REMOTE DATA"),
    ("prose", "Halifax | 42 | load tests\nRegina | 15 | notebooks\nLaval | 84 | ledgers\n\nWho decides about the budget of a team? The people who have to live with it should, and they rarely do. We met twelve people who left because of that and two who came for it.\n\nOpinions differ on whether a test is worth the time it takes. It shows what a talk can not, and most people are glad of it in the end. The rest would have been unhappy anyway."),
    ("prose", "THE TIRED CLERK LEFT THE OFFICE BEFORE THE LETTER WAS SIGNED, AND NOBODY KNEW WHO HAD SENT IT.\n\nMost people work from a small room once a week, and nobody counts the hours. You have worked beside others and enjoyed it. Please tell us about the report that drew you here, and what you would change in it."),
    ("prose", "Notes\n\nTell the panel which report changed since your last attempt. It is better to say it early, because they will ask. When they do, be short.\n- dental cover\n- transit passes\n- quiet rooms\n- learning budget\nAll of this is the same for everyone who joins, and it does not change in the first year."),
    ("junk", "They will wait for a week if the forms are late, and so will the others.\n" + "CARD FRAUD PLAYBOOK RUST ROADMAP CARD FRAUD RUST PLAYBOOK ROADMAP RUST CARD FRAUD " * 6),
    ("junk", "The distance matters less than it did. Some of us once said that it can not be taught, only seen.\n" + "best hiring best data scientist vacancy jobs apply job jobs load tests job near me vacancy hiring salary " * 4),
    ("list", "There is more to the place than a desk, and they will show you around.\nflexible hours\ndental cover\nsurvey answers\nload tests\nnotebooks\nmentoring\nrelocation\ntransit passes\nledger entries\nquiet rooms\nparking\nlearning budget"),
    ("table", "We keep a list of what was paid, and it will be out of date by the time you read it.\nrole | town | from | to\nAnalyst | Guelph | 60000 | 90000\nEngineer | Oshawa | 80000 | 120000\nScientist | Laval | 85000 | 130000\nDeveloper | Barrie | 70000 | 99000\nAnalyst | Regina | 61000 | 88000\nClerk | Moncton | 41000 | 52000"),
)
#: Each example also stands for texts so many times as long.
LENGTHS = (1, 5, 20, 100, 1_000, 10_000)


@lru_cache(1)
def inspected() -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all examples, at all lengths, and the numbers of their kinds."""
    rows, kinds = [], []
    for kind, text in EXAMPLES:
        own, words = statistics(text), len(text.split())
        for n in LENGTHS:
            # repeated, a text has more words, but all shares stay; one line without an end grows with them
            longer = float(np.log1p(n * words)) if kind != "prose" and "\n" not in text else own[7]
            rows.append((float(np.log1p(n * words)), *own[1:7], longer, *own[8:]))
            kinds.append(KINDS.index(kind))
    return np.array(rows), np.array(kinds)


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, <statistics>) of every document; null and empty texts have zeros, repeated rows come out repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [statistics(t or "") for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=STATISTICS, dtype="float64")
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


class Mixture:
    """Weights, means and covariances of the components, in standardised statistics."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.centre, self.scale, self.weights, self.means, self.covariances = centre, scale, weights, means, covariances
        self.whiten = [np.linalg.inv(np.linalg.cholesky(c)) for c in covariances]
        self.log_scale = [np.log(np.diag(w)).sum() for w in self.whiten]

    def logs(self, raw: np.ndarray) -> np.ndarray:
        """(rows, components): log of weight times density."""
        x = (raw - self.centre) / self.scale
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m) in enumerate(zip(self.weights, self.means)):
            z = (x - m) @ self.whiten[k].T
            out[:, k] = np.log(max(w, 1e-300)) + self.log_scale[k] - 0.5 * np.einsum("ij,ij->i", z, z) - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def responsibilities(self, raw: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the components in each row, and the log-likelihood of the rows."""
        logs = self.logs(raw)
        top = logs.max(axis=1, keepdims=True)
        p = np.exp(logs - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, float((top + np.log(total)).sum())

    def kinds(self) -> list[str]:
        """The kind of each component: that of the examples that fall to it, else of the example nearest to it in its own spread."""
        raw, named = inspected()
        logs = self.logs(raw) - np.log(np.maximum(self.weights, 1e-300))
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        x = (raw - self.centre) / self.scale
        out = []
        for k in range(len(self.weights)):
            votes = np.bincount(named, weights=share[:, k], minlength=len(KINDS))
            far = (((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(axis=1)
            out.append(KINDS[int(votes.argmax()) if votes.max() > 0.5 else int(named[far.argmin()])])
        return out

    def clear(self, kinds: list[str]) -> tuple[list[int], list[int]]:
        """(components that are clearly prose, components that clearly aren't); what is in neither straddles."""
        share = self.means[:, -1] * self.scale[-1] + self.centre[-1]
        spread = np.sqrt(self.covariances[:, -1, -1]) * self.scale[-1]
        prose = [k for k, kind in enumerate(kinds) if kind == "prose" and share[k] - CLEAR * spread[k] > 0.5]
        other = [k for k, kind in enumerate(kinds) if kind != "prose" and share[k] + CLEAR * spread[k] < 0.5]
        return prose, other

    def state(self) -> tuple:
        """What a task needs to build it again."""
        return self.centre, self.scale, self.weights, self.means, self.covariances

    def sums(self, raw: np.ndarray) -> np.ndarray:
        """The sufficient statistics of some rows: mass, first and second moments of each component, and the log-likelihood."""
        r, log = self.responsibilities(raw)
        z = (raw - self.centre) / self.scale
        second = [((z * r[:, k : k + 1]).T @ z).ravel() for k in range(r.shape[1])]
        return np.append(np.column_stack([r.sum(axis=0), r.T @ z, np.stack(second)]).ravel(), log)

    def next(self, total: np.ndarray) -> Mixture:
        """The maximization step on sums over all rows."""
        d = len(self.centre)
        sums = total[:-1].reshape(len(self.weights), -1)
        mass = np.maximum(sums[:, 0], 1e-9)
        means = sums[:, 1 : 1 + d] / mass[:, None]
        covariances = sums[:, 1 + d :].reshape(-1, d, d) / mass[:, None, None] - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
        empty = sums[:, 0] < 1e-3
        covariances[empty], means[empty] = np.eye(d), self.means[empty]
        return Mixture(self.centre, self.scale, mass / mass.sum(), means, covariances)

    def fitted(self, sums: Callable[[Mixture], np.ndarray], n: int, tolerance: float = TOLERANCE) -> Mixture:
        """Rounds of expectation and maximization until the likelihood stands; ``sums`` gives the sums of a mixture over all rows."""
        own, before = self, None
        for _ in range(STUCK):
            total = sums(own)
            own, likelihood = own.next(total), total[-1] / n
            if before is not None and abs(likelihood - before) < tolerance * max(1.0, abs(before)):
                return own
            before = likelihood
        raise RuntimeError(f"the mixture has not settled in {STUCK} rounds")


def seeded(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> Mixture:
    """A mixture whose components start among the rows nearest to the examples of each kind (k-means++), fitted to these rows alone."""
    raw, named = inspected()
    x, examples = (rows - centre) / scale, (raw - centre) / scale
    nearest = named[np.stack([((x - e) ** 2).sum(axis=1) for e in examples]).argmin(axis=0)]
    rng = np.random.default_rng(1)
    means = []
    for kind, many in enumerate(COMPONENTS.values()):
        own = x[nearest == kind] if (nearest == kind).any() else examples[named == kind]
        chosen = [own.mean(axis=0)]
        far = ((own - chosen[0]) ** 2).sum(axis=1)
        for _ in range(many - 1):
            chosen.append(own[rng.choice(len(own), p=far / far.sum())] if far.sum() > 0 else own[0])
            far = np.minimum(far, ((own - chosen[-1]) ** 2).sum(axis=1))
        means += chosen
    k, d = len(means), len(centre)
    start = Mixture(centre, scale, np.full(k, 1 / k), np.array(means), np.repeat(np.eye(d)[None], k, axis=0))
    return start.fitted(lambda m: m.sums(rows), len(rows), TOLERANCE / 10)


def fit(stats: DataFrame) -> Mixture | None:
    """Fit the mixture to all rows of ``stats``; None for an empty table.

    A few rows give the seeds, so that the rounds over all rows are few.
    """
    names = list(STATISTICS)
    moments = stats.agg(F.count("*").alias("n"), *[F.avg(s).alias(f"m_{s}") for s in names], *[F.coalesce(F.stddev_pop(s), F.lit(0.0)).alias(f"s_{s}") for s in names]).first()
    if not moments.n:
        return None
    centre = np.array([moments[f"m_{s}"] for s in names])
    scale = np.array([max(moments[f"s_{s}"], 1e-6) for s in names])
    few = np.array([tuple(r) for r in stats.orderBy(F.xxhash64("doc_id"), *names).limit(SEED_ROWS).select(*names).collect()])

    def sums(mixture: Mixture) -> np.ndarray:
        state = mixture.state()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, total = Mixture(*state), 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + own.sums(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        rows = stats.select(*names).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(rows)])

    return seeded(few, centre, scale).fitted(sums, moments.n)


def classify(documents: DataFrame) -> DataFrame:
    """(doc_id, <statistics>, kind, p_prose, p_other): every document with its statistics, its kind and the probabilities that it falls to a component that clearly is, or clearly isn't, prose.

    Null and empty texts count as junk. Repeated rows come out repeated; an
    empty table gives no rows.
    """
    stats = cut(document_statistics(documents))
    mixture = fit(stats)
    if mixture is None:
        return stats.select("*", F.lit("junk").alias("kind"), F.lit(0.0).alias("p_prose"), F.lit(1.0).alias("p_other"))
    state, kinds = mixture.state(), mixture.kinds()
    prose, other = mixture.clear(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Mixture(*state)
        for pdf in batches:
            if len(pdf):
                r, _ = own.responsibilities(pdf[list(STATISTICS)].to_numpy(dtype="float64"))
                by = np.stack([r[:, [k == kind for k in kinds]].sum(axis=1) for kind in KINDS], axis=1)
                pdf["kind"] = np.array(KINDS)[by.argmax(axis=1)]
                pdf["p_prose"], pdf["p_other"] = r[:, prose].sum(axis=1), r[:, other].sum(axis=1)
                pdf.loc[pdf["log_words"] == 0, ["kind", "p_prose", "p_other"]] = ["junk", 0.0, 1.0]
            else:
                pdf = pdf.assign(kind=pd.Series(dtype="str"), p_prose=pd.Series(dtype="float64"), p_other=pd.Series(dtype="float64"))
            yield pdf

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS) + ", kind string, p_prose double, p_other double"
    return stats.mapInPandas(run, schema)


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents of which less than half of the characters belong to full sentences.

    The clear components decide; a document that falls to none of them with
    probability SURE is settled by its share of characters in full sentences.
    """
    unsure = (F.col("p_prose") < SURE) & (F.col("p_other") < SURE)
    return classify(documents).where((F.col("p_other") >= SURE) | (unsure & (F.col("sentence_share") < 0.5))).select("doc_id").dropDuplicates()
