"""Deduplication on a natural key, keeping the most complete row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.text import title_key
from catalith.functions.values import to_number
from catalith.operators.reports import count_where

EXAMPLES = 10


def is_text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("string", "char", "varchar")


def completeness(df: DataFrame, ignore: Sequence[str] = ()) -> Column:
    """How many cells of a row hold a value, NaN counting as none."""
    total = F.lit(0)
    for field in df.schema.fields:
        if field.name in ignore:
            continue
        cell = F.col(f"`{field.name}`")
        filled = cell.isNotNull()
        if field.dataType.typeName() in ("double", "float"):
            filled = filled & ~F.isnan(cell)
        total = total + filled.cast("int")
    return total


def _marked(df: DataFrame, order: str) -> DataFrame:
    """Adds the key, whether there is one, and the preference of each row."""
    key = title_key(F.col("title")) if "title" in df.columns else F.lit("")
    year = F.col("release_year") if "release_year" in df.columns else F.lit(None).cast("int")
    votes = (
        F.coalesce(to_number(F.col("imdb_votes"), is_text(df, "imdb_votes")), F.lit(-1.0))
        if "imdb_votes" in df.columns
        else F.lit(-1.0)
    )
    return df.withColumns(
        {
            "_key": key,
            "_year": year,
            "_filled": completeness(df, ignore=(order,)),
            "_votes": votes,
        }
    ).withColumn("_has_key", (F.col("_key") != "") & F.col("_year").isNotNull())


_MARKS = ("_key", "_year", "_has_key", "_filled", "_votes")


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of every group.

    The rank filter sits directly on the window, so each task drops all but one
    row per key before the shuffle: a key that holds a third of the table sends
    one row per task. A digest leads the key, since sorting compares it first and
    seldom has to go on to long strings.
    """
    digested = df.withColumn("_digest", F.xxhash64(*keys))
    group = Window.partitionBy("_digest", *keys).orderBy(*order)
    ranked = digested.withColumn("_rank", F.row_number().over(group))
    return ranked.where(F.col("_rank") == 1).drop("_rank", "_digest")


def remove_duplicates(df: DataFrame, order: str = "row_pos") -> DataFrame:
    """One row per (title key, year): completest, most votes, then first in input.

    Rows without a key are all kept. Their own position is part of the group,
    which spreads them instead of sending them to one task.
    """
    kept = keep_first(
        _marked(df, order),
        [F.col("_key"), F.col("_year"), F.when(~F.col("_has_key"), F.col(order))],
        [F.col("_filled").desc(), F.col("_votes").desc(), F.col(order)],
    )
    return kept.drop(*_MARKS)


def keep_one_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """The same rule on whole texts: one row per collapsed lower-case text.

    The group key is a digest, so the shuffle does not sort long strings.
    """
    key = title_key(F.col(text))
    marked = df.withColumn("_key", F.sha2(key, 256)).withColumn("_blank", key == "")
    kept = keep_first(
        marked,
        [F.col("_key"), F.when(F.col("_blank"), F.col(order))],
        [completeness(df, ignore=(order,)).desc(), F.col(order)],
    )
    return kept.drop("_key", "_blank")


def dedup_counters(kept: DataFrame, rows_in: Column) -> list:
    """Rows removed and rows without a key, told from the rows that were kept.

    All rows without a key are kept, so nothing has to be grouped again.
    """
    key = title_key(F.col("title")) if "title" in kept.columns else F.lit("")
    year = F.col("release_year") if "release_year" in kept.columns else F.lit(None)
    keyless = (key == "") | year.isNull()
    return [
        ("duplicates_removed", "", F.first(rows_in) - F.count(F.lit(1)), None),
        ("rows_missing_dedup_key", "", count_where(keyless), None),
    ]


def dropped_examples(df: DataFrame, order: str = "row_pos", n: int = EXAMPLES) -> DataFrame:
    """The first dropped rows in preference order, as (title, release_year)."""
    marked = _marked(df, order)
    kept = remove_duplicates(df, order).select(order)
    dropped = marked.where("_has_key").join(kept, order, "left_anti")
    return (
        dropped.orderBy(F.col("_filled").desc(), F.col("_votes").desc(), F.col(order))
        .limit(n)
        .select(
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce(F.col("_year").cast("string"), F.lit("")).alias("release_year"),
        )
    )
