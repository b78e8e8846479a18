"""Exact quantiles per group, without gathering a group in one task.

Values are first counted, which shrinks every group to its distinct values. A
group that still has too many is narrowed to the ranges its ranks fall in, until
it has few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.session import settle

# Distinct values of one group that a single window may walk through.
WINDOW_VALUES = 1_000_000
_BINS_PER_UNIT = 64
_EQUAL_BINS = 4096


def value_counts_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value, n``: how often each value occurs in each group."""
    return (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    )


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    match = F.lit(True)
    for key in keys:
        match = match & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return match


def _at_wanted_ranks(
    rows: DataFrame, within: Sequence[str], order: str, probabilities: Sequence[float]
) -> DataFrame:
    """Rows that hold a rank next to a quantile, once per ``p``.

    ``_before`` says how many rows of the group lie before the window. A row
    holds the ranks from ``_from`` up to, but not including, ``_to``.
    """
    ordered = Window.partitionBy(*within).orderBy(order)
    upto = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("_total") - 1) * F.col("p")
    return (
        rows.withColumn("_to", upto + F.col("_before"))
        .withColumn("_from", F.col("_to") - F.col("n"))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("_share", at - F.floor(at))
        .where((F.col("_from") <= F.ceil(at)) & (F.col("_to") > F.floor(at)))
    )


def _narrowed(
    rows: DataFrame,
    within: Sequence[str],
    value: str,
    bins: Column,
    probabilities: Sequence[float],
    name: str,
) -> DataFrame:
    """Only the bins that hold a wanted rank, each with what lies before it.

    Bin totals alone go through the window, a few thousand per group.
    """
    binned = rows.withColumn(name, bins)
    totals = binned.groupBy(*within, name).agg(
        F.sum("n").alias("n"),
        F.first("_before").alias("_before"),
        F.first("_total").alias("_total"),
        F.min(value).cast("double").alias("_least"),
        F.max(value).cast("double").alias("_most"),
    )
    wanted = (
        _at_wanted_ranks(totals, within, name, probabilities)
        .select(*within, name, "_from", "_total", "_least", "_most")
        .distinct()
    )
    return (
        binned.alias("v")
        .join(wanted.alias("w"), _same("v", "w", [*within, name]))
        .select(
            *[F.col(f"v.{c}").alias(c) for c in [*within, name, value, "n"]],
            F.col("w._from").alias("_before"),
            "w._total",
            "w._least",
            "w._most",
        )
    )


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    window_values: int = WINDOW_VALUES,
) -> DataFrame:
    """``keys, p, quantile, n`` with linear interpolation between ranks.

    NULL values are not counted; a NULL key is a group of its own.
    """
    keys = list(keys)
    counts = settle(value_counts_by(df, keys, value), "value-counts")
    return quantiles_of_counts(counts, keys, value, probabilities, window_values)


def quantiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    window_values: int = WINDOW_VALUES,
) -> DataFrame:
    """The same from stored ``keys, value, n``, each value of a group once."""
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_distinct"), F.sum("n").alias("_total")
    )
    largest = sizes.agg(F.max("_distinct")).first()[0] or 0
    if largest <= window_values:
        total = F.sum("n").over(Window.partitionBy(*keys))
        rows = counts.withColumns({"_before": F.lit(0).cast("bigint"), "_total": total})
        within = keys
    else:
        rows = (
            counts.alias("v")
            .join(sizes.alias("s"), _same("v", "s", keys))
            .select("v.*", "s._total", F.lit(0).cast("bigint").alias("_before"))
        )
        # First by magnitude, then again and again evenly between the least and
        # the most of the bins that were hit, until what is left is small.
        number = F.col(value).cast("double")
        span = F.col("_most") - F.col("_least")
        bins = F.signum(number) * F.floor(F.log1p(F.abs(number)) * _BINS_PER_UNIT)
        evenly = F.floor((number - F.col("_least")) / span * _EQUAL_BINS)
        within = list(keys)
        while largest > window_values:
            name = f"_bin{len(within)}"
            narrowed = _narrowed(rows, within, value, bins, probabilities, name)
            rows = settle(narrowed, "narrowed")
            within.append(name)
            left = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
            largest = left.agg(F.max("_n")).first()[0]
            bins = F.when(span > 0, evenly).otherwise(0)

    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    return (
        _at_wanted_ranks(rows, within, value, probabilities)
        .groupBy(*keys, "p")
        .agg(
            (low + (high - low) * F.first("_share")).alias("quantile"),
            F.first("_total").alias("n"),
        )
    )
