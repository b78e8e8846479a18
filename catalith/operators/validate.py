"""Checks on a table of search requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith import fixed

# The arguments each request kind takes.
ARGUMENTS = {
    "search": ("query", "top_k", "genre_filter", "min_imdb_rating", "mpaa_rating", "decade"),
    "title": ("title",),
    "id": ("movie_id",),
    "similar": ("movie_id", "top_k"),
}
_REQUIRED = {"search": "query", "title": "title", "id": "movie_id", "similar": "movie_id"}


def _outside(column: str, low: float, high: float) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).between(low, high)


def rejection_reason(df: DataFrame, kind: str) -> Column:
    """Why a request is refused, NULL for a good one. First reason wins.

    A ``top_k`` out of range is no reason: it is clamped when the search runs.
    """
    needed = _REQUIRED[kind]
    reason = F.when(
        F.col(needed).isNull() | (F.length(needed) == 0), F.lit(f"{needed} must not be empty")
    )
    if kind == "search":
        for column, (low, high) in (
            ("min_imdb_rating", fixed.RATING_RANGE),
            ("decade", fixed.DECADE_RANGE),
        ):
            if column in df.columns:
                text = f"{column} must be between {low:g} and {high:g}"
                reason = reason.when(_outside(column, low, high), F.lit(text))
    return reason


def check_arguments(df: DataFrame, kind: str, ids: tuple[str, ...] = ("query_id",)) -> None:
    """An argument the request kind does not know is an error of the whole table."""
    unknown = [c for c in df.columns if c not in ARGUMENTS[kind] and c not in ids]
    if unknown:
        raise ValueError(f"unknown arguments for {kind}: {unknown}")


def split_requests(
    df: DataFrame, kind: str = "search", ids: tuple[str, ...] = ("query_id",)
) -> tuple[DataFrame, DataFrame]:
    """Good requests, and refused ones with a ``reason``."""
    check_arguments(df, kind, ids)
    judged = df.withColumn("reason", rejection_reason(df, kind))
    good = judged.where(F.col("reason").isNull()).drop("reason")
    return good, judged.where(F.col("reason").isNotNull())
