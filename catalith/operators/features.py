"""Derived features and the text that is embedded, from observed facts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions.values import decade_of, half_even, to_number
from catalith.operators.dedup import is_text
from catalith.operators.impute import flag_name
from catalith.operators.reports import count_where, long_report, union_reports


def _number(df: DataFrame, column: str) -> Column:
    if column not in df.columns:
        return F.lit(None).cast("double")
    return to_number(F.col(column), is_text(df, column))


def _measured(df: DataFrame, column: str, value: Column) -> Column:
    """NULL where the value was filled in."""
    if flag_name(column) not in df.columns:
        return value
    return F.when(~F.coalesce(F.col(flag_name(column)), F.lit(False)), value)


def observed_number(df: DataFrame, column: str) -> Column:
    return _measured(df, column, _number(df, column))


def observed(df: DataFrame, column: str) -> Column:
    """The value as it was recorded; NULL for a gap, a filled cell or the Unknown word."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    value = F.col(column)
    if is_text(df, column):
        value = F.when(value != fixed.UNKNOWN, value)
    return _measured(df, column, value)


def budget_band(budget: Column) -> Column:
    bands = F
    for limit, name in fixed.BUDGET_BANDS:
        bands = bands.when(budget < limit, name)
    return bands.when(budget.isNotNull(), fixed.TOP_BAND)


def add_derived_features(df: DataFrame) -> DataFrame:
    """``decade``, ``budget_tier``, ``rating_score_delta``, ``blockbuster_flag``."""
    budget = F.col("_budget")
    bar = F.greatest(
        F.lit(fixed.HIT_FLOOR),
        F.coalesce(budget * fixed.HIT_MULTIPLE, F.lit(fixed.HIT_FLOOR)),
    )
    delta = observed_number(df, "imdb_rating") * 10.0 - observed_number(df, "rt_rating")
    return (
        df.withColumn("_budget", observed_number(df, "production_budget"))
        .withColumns(
            {
                "decade": decade_of(_number(df, "release_year")),
                "budget_tier": budget_band(budget),
                "rating_score_delta": delta,
                "blockbuster_flag": _number(df, "worldwide_gross") >= bar,
            }
        )
        .drop("_budget")
    )


def _whole(value: Column) -> Column:
    return half_even(value.cast("double"), 0).cast("bigint").cast("string")


def _grouped(value: Column) -> Column:
    return F.format_number(half_even(value.cast("double"), 0).cast("bigint"), 0)


def _rating_line(df: DataFrame) -> Column:
    rating = half_even(observed(df, "imdb_rating").cast("double"), 1)
    votes = observed(df, "imdb_votes").cast("double").cast("bigint")
    return F.concat(
        F.lit("IMDB Rating: "),
        F.format_number(rating, 1),
        F.lit("/10"),
        F.coalesce(
            F.concat(F.lit(" ("), F.format_number(votes, 0), F.lit(" votes)")), F.lit("")
        ),
    )


def augmented_text(df: DataFrame) -> Column:
    """Up to twelve labelled lines; a line without an observed value is left out."""

    def line(label: str, column: str, shape=None, after: str = "") -> Column:
        value = observed(df, column)
        value = shape(value) if shape else value.cast("string")
        return F.concat(F.lit(label), value, F.lit(after))

    # Labels and order of the lines.
    return F.concat_ws(
        "\n",
        line("Title: ", "title"),
        line("Genre: ", "major_genre"),
        line("Director: ", "director"),
        line("MPAA Rating: ", "mpaa_rating"),
        line("Release Year: ", "release_year", _whole),
        line("Runtime: ", "running_time_min", _whole, " minutes"),
        _rating_line(df),
        line("Rotten Tomatoes: ", "rt_rating", _whole, "%"),
        line("Budget: $", "production_budget", _grouped),
        line("Distributor: ", "distributor"),
        line("Creative Type: ", "creative_type"),
        line("Source: ", "source"),
    )


def augment(df: DataFrame) -> DataFrame:
    """The whole stage."""
    derived = add_derived_features(df)
    return derived.withColumn("augmented_text", augmented_text(derived))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n`` of a column, missing values dropped."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def augmentation_report(df: DataFrame) -> DataFrame:
    """Counters of the stage for augmented input ``df``."""
    text = F.col("augmented_text")
    lines = F.when(text != "", F.size(F.split(text, "\n"))).otherwise(0)
    tiers = [name for _, name in fixed.BUDGET_BANDS] + [fixed.TOP_BAND]
    counters = [
        *[("feature_coverage", c, F.count(c), None) for c in fixed.DERIVED_FEATURES],
        *[
            ("budget_tier_counts", tier, count_where(F.col("budget_tier") == tier), None)
            for tier in tiers
        ],
        ("augmented_text_rows", "", count_where(text != ""), None),
        ("augmented_text_empty", "", count_where(text == ""), None),
        ("mean_text_lines", "", F.round(F.coalesce(F.avg(lines), F.lit(0.0)), 2), None),
    ]
    return union_reports(long_report(df, "augmentation", counters))
