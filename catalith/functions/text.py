"""Text expressions: spaces, sentinels, aliases, keys, prefixes, trigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith import fixed

# Java's \s is ASCII-only without (?U); the separators x1c-x1f are not in it at all.
_SPACE = r"[\s\x1c-\x1f]"


def collapse_spaces(text: Column) -> Column:
    """Every run of whitespace becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def strip(text: Column) -> Column:
    """Whitespace removed at both ends only."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|(?<!{_SPACE}){_SPACE}+\z", "")


def null_sentinels(text: Column) -> Column:
    """NULL for a spelling of "no value"."""
    return F.when(~F.lower(text).isin(*fixed.SENTINELS), text)


def canonical_rating(text: Column) -> Column:
    """The official spelling of a rating label; others pass through."""
    pairs = [F.lit(word) for entry in fixed.RATING_ALIASES.items() for word in entry]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(text)), text)


def title_key(title: Column) -> Column:
    """Grouping form of a title, ``''`` when there is none."""
    return F.coalesce(F.lower(collapse_spaces(title.cast("string"))), F.lit(""))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def with_prefix(text: Column, prefix: str) -> Column:
    """Stripped text that starts with the task prefix exactly once."""
    body = strip(text)
    return F.when(body.startswith(prefix), body).otherwise(F.concat(F.lit(prefix), body))


def trigrams(text: Column) -> Column:
    """Distinct trigrams, by the rule PostgreSQL documents for ``pg_trgm``.

    Each word of lower-case letters and digits is padded with two spaces before
    and one after.
    """
    words = F.filter(
        F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"),
        lambda word: word != "",
    )
    grams = F.transform(
        words,
        lambda word: F.transform(
            F.sequence(F.lit(1), F.length(word) + 1),
            lambda at: F.substring(F.concat(F.lit("  "), word, F.lit(" ")), at, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def set_similarity(left: Column, right: Column) -> Column:
    """Shared part of two sets, 0 when both are empty."""
    shared = F.size(F.array_intersect(left, right))
    every = F.size(left) + F.size(right) - shared
    return F.when(every > 0, shared / every).otherwise(F.lit(0.0))
