"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def occurrences(text: Column, token: Column) -> Column:
    """How often a token occurs, overlaps not counted."""
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after."""
    words = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def containment(query: Column, text: Column) -> Column:
    """Part of the query's trigrams that the text has: the set form of word similarity."""
    q = trigrams(query)
    return F.try_divide(F.size(F.array_intersect(q, trigrams(text))).cast("double"), F.size(q))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays taken as sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def scrub(text: Column) -> Column:
    """Mail addresses, telephone numbers and home folders replaced."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<mail>")
    out = F.regexp_replace(out, r"\+?[0-9][0-9 ()-]{7,}[0-9]", "<phone>")
    return F.regexp_replace(out, r"(/home/|/Users/|C:\\Users\\)[^/\\\s]+", "$1<user>")


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule (pattern, name) that matches."""
    out = F.lit(otherwise)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
