"""Numeric and date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith import fixed

# A number with optional spaces around it, of any size. Spark would read '5d' as a
# double, so the shape is tested.
_NUMBER = (
    r"(?U)\A[\s\x1c-\x1f]*"
    r"([+-]?(?:(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?|(?i:inf(?:inity)?)))"
    r"[\s\x1c-\x1f]*\z"
)


def to_number(cell: Column, from_text: bool) -> Column:
    """A double, or NULL; what is too large for one is infinite, and never in bounds."""
    if from_text:
        return F.regexp_extract(cell, _NUMBER, 1).try_cast("double")
    number = cell.cast("double")
    return F.when(~F.isnan(number), number)


def in_bounds(number: Column, low: float | None, high: float | None) -> Column:
    """True for a finite number inside inclusive bounds; NULL for a missing one."""
    inside = F.abs(number) < float("inf")
    inside = inside if low is None else inside & (number >= low)
    return inside if high is None else inside & (number <= high)


def half_even(number: Column, decimals: int) -> Column:
    """Round half to even, on the scaled binary value."""
    if decimals == 0:
        return F.rint(number)
    scale = 10.0**decimals
    return F.rint(number * scale) / scale


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def parse_date(text: Column, layouts: Sequence[str] = fixed.DATE_LAYOUTS) -> Column:
    """A date from collapsed text by the first layout that fits, else NULL."""
    tried = [F.try_to_timestamp(text, F.lit(layout)).cast("date") for layout in layouts]
    return F.coalesce(*tried)


def undo_century(date: Column, last_year: int) -> Column:
    """Move a date after ``last_year`` back by a century, month and day kept."""
    return F.when(F.year(date) > last_year, F.add_months(date, -1200)).otherwise(date)
