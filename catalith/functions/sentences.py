"""Search filters read out of a plain sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith import fixed

# Case-insensitive with Unicode word boundaries, digits and spaces.
_FLAGS = "(?iuU)"


def _says(sentence: Column, pattern: str) -> Column:
    return sentence.rlike(_FLAGS + pattern)


def _first_hit(sentence: Column, phrases) -> Column:
    return F.coalesce(*[F.when(_says(sentence, p), F.lit(value)) for p, value in phrases])


def genre_of(sentence: Column) -> Column:
    return _first_hit(sentence, [(rf"\b{p}\b", genre) for p, genre in fixed.GENRE_PHRASES])


def rating_label_of(sentence: Column) -> Column:
    return _first_hit(sentence, fixed.RATING_PHRASES)


def decade_of_sentence(sentence: Column) -> Column:
    """Four digits first, then a name, then two digits (which are not floored)."""

    def digits(pattern: str) -> Column:
        return F.regexp_extract(sentence, _FLAGS + pattern, 1).try_cast("int")

    short = digits(fixed.DECADE_TWO_DIGITS)
    names = [(rf"\b{name}\b", decade) for name, decade in fixed.DECADE_NAMES]
    return F.coalesce(
        digits(fixed.DECADE_FOUR_DIGITS),
        _first_hit(sentence, names),
        F.when(short >= 20, short + 1900).otherwise(short + 2000),
    )


def rating_floor_of(sentence: Column, high: float = fixed.HIGH_RATING) -> Column:
    return F.when(_says(sentence, fixed.HIGH_RATING_PHRASE), F.lit(float(high)))
