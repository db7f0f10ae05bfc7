"""Problem 1: free-entered values to the entries of a canonical list.

Each reference list becomes a trie of entries and alias paths; a typed value
is cleaned of decoration and looked up with a Levenshtein automaton that
returns every path within the reach of its length (abbreviations among the
aliases have none). Values that reach no entry,
or that name another place of the same name, come out with ``UNMATCHED``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.trie import Trie

UNMATCHED = -1
#: Most entries of a reference list that is sent to every task; a longer list is refused (see README).
MAX_REFERENCE = 50_000

# Canadian provinces with the forms people type.
PROVINCES = {
    "british columbia": ("bc", "brit columbia", "colombie britannique"),
    "alberta": ("ab", "alta"),
    "saskatchewan": ("sk", "sask"),
    "manitoba": ("mb", "man"),
    "ontario": ("on", "ont"),
    "quebec": ("qc", "pq", "que"),
    "nova scotia": ("ns", "nouvelle ecosse"),
    "new brunswick": ("nb", "nouveau brunswick"),
    "newfoundland and labrador": ("nl", "nfld", "newfoundland", "nf", "terre neuve et labrador"),
    "prince edward island": ("pe", "pei", "ile du prince edouard"),
}
# Words around a place name that don't change the place.
AREA_WORDS = frozenset("greater metro metropolitan area region downtown inner central centre center city core grand the of suburbs gta office offices".split())
MODE_TEXT = re.compile(r"\b(?:\d+ ?(?:days?|x)(?: (?:a|per) week)?(?: in (?:the )?office)?|hybride?|on[- ]?site|in[- ]office|in[- ]person|flexible|sur place|full[- ]time|part[- ]time|permanent|relocation)\b")
POSTAL = re.compile(r"\b[a-z]\d[a-z] ?-?\d[a-z]\d\b")
REMOTE_TEXT = re.compile(r"\b(?:work(?:ing)? from (?:home|anywhere)|wfh|home[- ]?office|home[- ]based|tele-?work|teletravail|virtual|a distance)\b")
REMOTE_WORDS = ("remote", "remotely")
COUNTRY_WORDS = ("canada",)
WHOLE_WORDS = frozenset("all any anywhere across wide locations location within in only fully full based nationwide national throughout everywhere coast to from and or partout au 100 percent position work job jobs eligible".split())
# Short names in common use.
SHORT_NAMES = {"mtl": "montreal", "tor": "toronto", "van": "vancouver", "vic": "victoria", "cgy": "calgary", "edm": "edmonton", "wpg": "winnipeg", "ott": "ottawa", "hfx": "halifax", "ham": "hamilton", "poco": "port coquitlam", "sauga": "mississauga"}
PREFIXES = {"north": "n", "west": "w", "port": "p", "new": "n", "saint": "st", "mount": "mt", "maple": "m"}
MULTI = re.compile(r"[,;|/()\[\]:+]+| [-–—] |•")


MOST_EDITS = 3


def reach(length: int) -> int:
    """Edits allowed for a reference path of this length: none below 4 letters, then 1, from 6 letters 2, from 10 letters 3."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3


def plain(text: str) -> str:
    """Lower case, without accents and dots, white space collapsed."""
    text = unicodedata.normalize("NFKD", text.replace("’", "'"))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower().replace(".", "")
    return " ".join(text.split())


def squash(text: str) -> str:
    """Letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", text)


class LocationMatcher:
    """Typed locations to ref_locations, whose names read ``City, Province, Canada``."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.cities, self.provinces, self.words = Trie(), Trie(), Trie()
        self.province_of: dict[int, str] = {}
        self.remote = self.country = UNMATCHED
        for province, forms in PROVINCES.items():
            for form in (province, *forms):
                self.provinces.add(squash(form), province)
        for word in (*REMOTE_WORDS, *COUNTRY_WORDS):
            self.words.add(word, "remote" if word in REMOTE_WORDS else "country")
        for ref_id, name in rows:
            parts = [p.strip() for p in plain(name).split(",")]
            if len(parts) < 3:
                if parts[0].startswith("remote"):
                    self.remote = ref_id
                else:
                    self.country = ref_id
                continue
            self.province_of[ref_id] = parts[1]
            self._add(parts[0], ref_id)
            head, _, rest = parts[0].partition(" ")
            if rest and head in PREFIXES:
                self._add(PREFIXES[head] + rest, ref_id)
            if parts[0].endswith(" city"):
                self._add(parts[0][:-5], ref_id)
                self._add("ville de " + parts[0][:-5], ref_id)
        for form, ref_id in self._short(rows).items():
            self.cities.add(form, (ref_id, 0, True))
        self.city = lru_cache(200_000)(self._city)
        self.province = lru_cache(200_000)(self._province)
        self.word = lru_cache(200_000)(self._word)

    def _add(self, name: str, ref_id: int) -> None:
        """A path of ``ref_id`` with the reach of its length."""
        path = squash(name)
        self.cities.add(path, (ref_id, reach(len(path)), False))

    def _short(self, rows: list[tuple[int, str]]) -> dict[str, int]:
        """Abbreviated and turned-round names that mean one entry only: ``New West``, ``Rich Hill``, ``Miss``, ``Vancouver North``."""
        meant: dict[str, set[int]] = {}
        full = {}
        for ref_id, name in rows:
            words = plain(name).split(",")[0].split()
            if ref_id not in self.province_of:
                continue
            full["".join(words)] = ref_id
            forms = {"".join(words[1:] + words[:1])}
            for i, word in enumerate(words):
                for n in range(4 if len(words) == 1 else 3, len(word)):
                    forms.add("".join([*words[:i], word[:n], *words[i + 1 :]]))
            for form in forms:
                meant.setdefault(form, set()).add(ref_id)
        for form, name in SHORT_NAMES.items():
            if squash(name) in full:
                meant[form] = {full[squash(name)]}
        return {form: refs.pop() for form, refs in meant.items() if len(refs) == 1 and form not in full and not self._province(form)}

    def _city(self, text: str) -> tuple[tuple[int, int], ...]:
        """(distance, ref_id) of all paths that ``text`` is in reach of; a path may be longer than ``text`` by its own reach."""
        hits = [(d, *payload) for d, _, payload in self.cities.search(text, reach(len(text) + MOST_EDITS)) if d <= payload[1]]
        short = [(d, ref) for d, ref, _, abbreviation in hits if abbreviation]
        return tuple(short or [(d, ref) for d, ref, _, _ in hits])

    def _abbreviates(self, text: str) -> bool:
        return any(d == 0 and payload[2] for d, _, payload in self.cities.search(text, 0))

    def _province(self, text: str) -> tuple[int, str] | None:
        got = [(d, p) for d, path, p in self.provinces.search(text, min(2, reach(len(text)))) if d <= min(2, reach(len(path)))]
        return got[0] if got else None

    def _word(self, text: str) -> str | None:
        got = [kind for d, path, kind in self.words.search(text, 1 if len(text) > 4 else 0)]
        return got[0] if got else None

    def _provinces_off(self, tokens: list[str]) -> Iterator[tuple[list[str], str | None]]:
        """The tokens whole, and without a province at their end or start."""
        yield tokens, None
        for n in (3, 2, 1):
            if len(tokens) > n:
                if got := self.province(squash("".join(tokens[-n:]))):
                    yield tokens[:-n], got[1]
                if got := self.province(squash("".join(tokens[:n]))):
                    yield tokens[n:], got[1]

    def match(self, value: str) -> int:
        """The ref_id meant by ``value``, or UNMATCHED."""
        text = plain(value)
        text = re.sub(r"\bville de (?!quebec)", "", text)
        text = REMOTE_TEXT.sub(" remote ", MODE_TEXT.sub(" ", POSTAL.sub(" ", text)))
        segments, remote, country = [], False, False
        for k, segment in enumerate(MULTI.split(" " + text + " ")):
            tokens = [t for t in re.split(r"[^a-z0-9']+", segment) if t]
            kept = []
            for t in tokens:
                kind = self.word(t)
                if kind == "remote":
                    remote = True
                elif kind == "country" or (t in ("ca", "can") and (len(tokens) == 1 or k == 0 and t == tokens[0])):
                    country = True
                elif t not in AREA_WORDS or t == "city" and kept:
                    kept.append(t)
            if kept:
                segments.append(kept)
        places = [s for s in segments if not all(t in WHOLE_WORDS for t in s)]
        if not places:
            if remote:
                return self.remote
            return self.country if country else UNMATCHED
        if len(places) > 1:
            names = [s for s in places if not self.province(squash("".join(s)))]
            if len(names) > 1 and self._abbreviates(joined := squash("".join(t for s in names for t in s))):
                places = [s for s in places if s not in names] + [[joined]]
        given: set[str] = set()
        best: list[tuple[int, int, int, frozenset]] = []
        unknown = 0
        for tokens in places:
            if (got := self.province(squash("".join(tokens)))) and not (got[0] and self.city(squash("".join(tokens))) and self.city(squash("".join(tokens)))[0][0] < got[0]):
                given.add(got[1])
                if not any(c for c in self.city(squash("".join(tokens))) if c[0] <= got[0]):
                    continue
                options = [(d, ref, 1, frozenset()) for d, ref in self.city(squash("".join(tokens)))]
                best.extend((d, 1, ref, own) for d, ref, _, own in options)
                continue
            options = []
            for rest, province in self._provinces_off(tokens):
                name = squash("".join(t for t in rest if t not in WHOLE_WORDS) or "".join(rest))
                if not name:
                    continue
                inner = [len(t) for i, t in enumerate(rest) if len(rest) > 1 and any(c[0] == 0 for c in self.city(squash("".join(rest[:i] + rest[i + 1 :]))))]
                for d, ref in self.city(name):
                    if inner and d >= min(inner):
                        continue  # an exact place name beside a word of its own, such as a foreign state
                    if province and self.province_of[ref] != province:
                        continue
                    options.append((d, 0, ref, frozenset([province] if province else [])))
            if options:
                best.extend(options)
            else:
                unknown += 1
        if unknown or not best:
            return UNMATCHED
        fits = [b for b in best if not given or self.province_of[b[2]] in given]
        if not fits:
            return UNMATCHED
        # a province that is also a city (Quebec) only counts where nothing else names a place
        named = [b for b in fits if b[1] == 0]
        low = min(b[0] for b in (named or fits))
        refs = {b[2] for b in (named or fits) if b[0] == low}
        if not named and given and low == 0 and len(places) < 2:
            return UNMATCHED
        return refs.pop() if len(refs) == 1 else UNMATCHED


class SizeLabelMatcher:
    """Typed company sizes to ref_size_labels; a head count means the label whose bounds hold it."""

    NUMBER = re.compile(r"\d+(?:[ ,']\d{3})+(?!\d)|\d+(?:\.\d+)?")
    # Number words that stand for a head count.
    WORDS = {"ten": "10", "fifty": "50", "hundred": "100", "two hundred": "200", "five hundred": "500", "thousand": "1000"}

    def __init__(self, rows: list[tuple[int, str, int, int | None]]):
        self.rows = rows
        self.trie = Trie()
        for ref_id, label, low, high in rows:
            self.trie.add(squash(plain(label).replace(",", "")), ref_id)
            if high is not None:
                for path in (f"{low}to{high}", f"{low}to{high}employees", f"{high}to{low}"):
                    self.trie.add(path, ref_id)
            else:
                for path in (f"{low}plus", f"{low - 1}plus", f"over{low - 1}", f"{low}ormore"):
                    self.trie.add(path, ref_id)
        self.first_high = min((high for _, _, _, high in rows if high is not None), default=0)
        self.last_low = max((low for _, _, low, _ in rows), default=0)

    @staticmethod
    def digits(text: str) -> str:
        """Letters that stand for digits inside figures read as digits."""
        def fix(m: re.Match) -> str:
            return m.group().replace("o", "0").replace("l", "1").replace("i", "1")

        text = re.sub(r"(?<![a-z])(?=[olis]*\d)[\dol,]+(?![a-z0-9])", fix, text)
        return re.sub(r"\bt0\b", "to", text)

    def match(self, value: str) -> int:
        """The ref_id meant by ``value``, or UNMATCHED."""
        text = plain(value.replace(" ", " ").replace(".", "\x00")).replace("\x00", ".").replace("..", " to ")
        text = self.digits(text.replace("_", " to "))
        for word, figure in self.WORDS.items():
            text = re.sub(rf"\b{word}\b", figure, text)
        figures = re.findall(r"\d+", re.sub(r"(?<=\d)[ ,'](?=\d{3}(?!\d))", "", text))
        path = squash(text)
        near = {ref for d, at, ref in self.trie.search(path, min(2, reach(len(path)))) if re.findall(r"\d+", at) == figures and figures} if len(figures) < 3 else set()
        if len(near) == 1:
            return near.pop()
        numbers = []
        for m in self.NUMBER.finditer(text):
            number = float(re.sub(r"[ ,']", "", m.group()))
            tail = text[m.end() : m.end() + 2]
            if re.match(r" ?k(?![a-z])", tail):
                number *= 1000
            numbers.append(number)
        if not numbers or len(numbers) > 2 or any(x < 0 for x in numbers):
            return UNMATCHED
        if len(numbers) == 2:
            low, high = sorted(numbers)
            exact = [r for r, _, a, b in self.rows if b is not None and abs(a - low) <= 1 and abs(b - high) <= 1]
            held = [r for r, _, a, b in self.rows if a <= low + 1 and (b is None or high <= b)]
            got = exact or held
            return got[0] if len(got) == 1 else UNMATCHED
        n = numbers[0]
        if re.search(r"\+|plus|more|over|above|>|at least|exceed|excess|minimum|greater|ou plus|plus de", text):
            if re.search(r"more than|over|above|>|exceed|greater|plus de|\+|plus", text) and any(n == b for _, _, _, b in self.rows):
                n += 1
        elif re.search(r"under|fewer|less|below|<|up to|at most|moins", text) and not any(n == b for _, _, _, b in self.rows):
            n -= 1
        got = [r for r, _, a, b in self.rows if a <= n and (b is None or n <= b)]
        return got[0] if len(got) == 1 else UNMATCHED


def bounded(reference: DataFrame, columns: list[str]) -> list[tuple]:
    """The rows of a reference list, after a check that it is small enough to be sent to every task."""
    rows = reference.select(*columns).limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"a reference list of more than {MAX_REFERENCE} entries can't be sent to every task")
    return [tuple(r) for r in rows]


def map_values(values: DataFrame, keys: list[str], locations: DataFrame, sizes: DataFrame) -> DataFrame:
    """(keys..., field_name, value) to the same rows with ``ref_id``.

    No shuffle: each task looks up its own rows and remembers the values it has
    seen, so a value that a third of the rows share costs one look-up per task.
    Nulls and blanks are dropped before; an empty table gives no rows; repeated
    rows come out repeated.
    """
    places = bounded(locations, ["ref_id", "location_name"])
    labels = bounded(sizes, ["ref_id", "size_label", "min_employees", "max_employees"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, label = LocationMatcher(places), SizeLabelMatcher(labels)
        seen: dict[tuple[str, str], int] = {}
        for pdf in batches:
            out = []
            for field, value in zip(pdf["field_name"], pdf["value"]):
                ref = seen.get((field, value))
                if ref is None:
                    ref = (place if field == "location" else label).match(value)
                    if len(seen) < 500_000:
                        seen[field, value] = ref
                out.append(ref)
            pdf["ref_id"] = pd.array(out, dtype="int64")
            yield pdf

    kinds = dict(values.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", field_name string, value string, ref_id long"
    return values.select(*keys, "field_name", "value").mapInPandas(run, schema)


def typed_values(jobs: DataFrame, locations: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each jobs row and field whose value is neither null nor blank nor letter for letter an entry."""
    exact = {
        "location": [r[0] for r in bounded(locations, ["location_name"])],
        "company_employees_label": [r[0] for r in bounded(sizes, ["size_label"])],
    }

    def open_value(field: str) -> Column:
        value = F.col(field)
        inside = value.isin(exact[field]) if exact[field] else F.lit(False)
        return F.when(value.isNotNull() & value.rlike(r"[^\s ]") & ~inside, F.struct(F.lit(field).alias("field_name"), value.alias("value")))

    return jobs.select("job_id", F.explode(F.array_compact(F.array(open_value("location"), open_value("company_employees_label")))).alias("v")).select("job_id", "v.*")


def canonical_values(jobs: DataFrame, locations: DataFrame, sizes: DataFrame) -> DataFrame:
    """(job_id, field_name, value, ref_id) for every open value of ``jobs``; ref_id is -1 where no entry is meant."""
    return map_values(typed_values(jobs, locations, sizes), ["job_id"], locations, sizes)
