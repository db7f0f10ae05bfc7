"""Text columns: normalisation, fingerprints, token sets, description layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python calls a non-word character other than white space.
PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def normalize_text(text: Column) -> Column:
    """Lower case, each punctuation mark a space, white space collapsed and trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, " "), r"\s+", " "))


def fingerprint(title: Column, company: Column) -> Column:
    """``title|company``, lower case, punctuation removed without a space in its place, white space collapsed."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, ""), r"\s+", " "))
    return F.concat_ws("|", bare(title), bare(company))


def split_words(text: Column) -> Column:
    """The word tokens of a text, repeated as they are there, and perhaps empty strings."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def tokenize(text: Column) -> Column:
    """The distinct word tokens of a text; an empty array for null or empty text."""
    return F.coalesce(F.array_distinct(F.filter(split_words(text), lambda t: t != "")), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets, 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def sorted_tokens(text: Column) -> Column:
    """White-space separated tokens in order, joined by single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda t: t != "")), " ")


def format_description(text: Column) -> Column:
    """Runs of blanks closed up, a blank line before each sentence that follows a full stop, lines trimmed, at most one blank line in a row."""
    spaced = F.regexp_replace(text, r"\r|\t| {2,}", " ")
    broken = F.regexp_replace(spaced, r"\.\s+(?=[A-Z][a-z])", ".\n\n")
    lines = F.transform(F.split(broken, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
