"""Catalog statistics and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators.reports import count_where
from catalith.operators.search import Filters


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows, distinct genres, first and last year, mean rating."""
    return df.agg(
        F.count(F.lit(1)).alias("total_movies"),
        F.count_distinct("major_genre").alias("genres"),
        F.min("release_year").alias("year_min"),
        F.max("release_year").alias("year_max"),
        F.avg(F.col("imdb_rating").cast("double")).alias("avg_imdb_rating"),
    )


#: Size of the sketches of distinct values: 2 to this power registers, off by 0.6 % on average.
SKETCH_LG_K = 15


def stats_state(df: DataFrame) -> DataFrame:
    """The statistics of one load as one row that merges with those of others."""
    rating = F.col("imdb_rating").cast("double")

    def distinct(value: Column) -> Column:
        return F.hll_sketch_agg(value, F.lit(SKETCH_LG_K))

    title = F.concat_ws("#", F.lower("title"), F.col("release_year").cast("string"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct(F.col("major_genre")).alias("genres"),
        distinct(title).alias("titles"),
        F.min("release_year").alias("year_min"),
        F.max("release_year").alias("year_max"),
        F.sum(rating).alias("rating_sum"),
        F.count(rating).alias("ratings"),
    )


def merged_stats(states: DataFrame) -> DataFrame:
    """``dataset_stats`` and the distinct (title, year) keys, from the states of loads.

    Distinct counts come from united sketches (HLL); values that several loads have count once. The
    other figures are exact, over the rows of all loads.
    """

    def distinct(name: str) -> Column:
        return F.hll_sketch_estimate(F.hll_union_agg(name))

    return states.agg(
        F.sum("rows").alias("total_movies"),
        distinct("genres").alias("genres"),
        distinct("titles").alias("titles"),
        F.min("year_min").alias("year_min"),
        F.max("year_max").alias("year_max"),
        F.try_divide(F.sum("rating_sum"), F.sum("ratings")).alias("avg_imdb_rating"),
    )


def list_facets(df: DataFrame, column: str = "major_genre") -> DataFrame:
    """Distinct values in order, missing ones left out."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, missing, rows`` for every column, in one pass."""
    names = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_where(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(names)],
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col("rows")
                    )
                    for i, c in enumerate(names)
                ]
            )
        )
    )


def load_audit(df: DataFrame, dim: int) -> DataFrame:
    """Rows, embedded rows, widest vector, and whether all is as expected."""
    size = F.size("embedding")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("embedding").alias("embedded"),
        F.coalesce(F.max(F.when(F.col("embedding").isNotNull(), size)), F.lit(0)).alias("dim"),
    ).withColumn(
        "ok",
        (F.col("rows") > 0) & (F.col("rows") == F.col("embedded")) & (F.col("dim") == dim),
    )


def dimension_counts(df: DataFrame) -> DataFrame:
    """Embedded rows by vector length."""
    return (
        df.where(F.col("embedding").isNotNull())
        .groupBy(F.size("embedding").alias("dim"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def filter_violations(results: DataFrame, filters: Filters) -> DataFrame:
    """How many result rows break a filter that was asked for.

    A result shows its year, not its decade, so that filter is checked on it.
    """
    broken = F.lit(False)
    if filters.genre_filter is not None:
        broken = broken | ~F.col("major_genre").eqNullSafe(filters.genre_filter)
    if filters.mpaa_rating is not None:
        broken = broken | ~F.col("mpaa_rating").eqNullSafe(filters.mpaa_rating)
    if filters.min_imdb_rating is not None:
        rating = F.col("imdb_rating")
        broken = broken | rating.isNull() | (rating < filters.min_imdb_rating)
    if filters.decade is not None:
        year = F.col("release_year")
        inside = year.between(filters.decade, filters.decade + 9)
        broken = broken | ~F.coalesce(inside, F.lit(False))
    return results.agg(F.count(F.lit(1)).alias("rows"), count_where(broken).alias("violations"))


def facet_audit(df: DataFrame, column: str = "major_genre") -> DataFrame:
    """Do the facet list and the statistics agree on genres and rows?"""
    facets = list_facets(df, column).select(F.count(F.lit(1)).alias("n")).scalar()
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return (
        dataset_stats(df)
        .select("genres", facets.alias("facets"), "total_movies", total.alias("rows"))
        .withColumn(
            "ok", (F.col("genres") == F.col("facets")) & (F.col("total_movies") == F.col("rows"))
        )
    )


def repeated_keys(df: DataFrame) -> DataFrame:
    """Natural keys that more than one stored row has; none after a sound load."""
    return (
        df.where(F.col("title").isNotNull() & F.col("release_year").isNotNull())
        .groupBy(F.lower("title").alias("title_key"), "release_year")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def _row_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def group_digests(df: DataFrame, group: Column, ignore: Sequence[str] = ("updated_at",)) -> DataFrame:
    """``part, n, digest``: what the rows of each group add up to, in whatever order.

    A task sums its own rows, so a row per group and task is shuffled, not one per row. The digest adds
    up four numbers of 60 bits of each row's digest; other rows give it by chance only.
    """
    columns = [c for c in df.columns if c not in ignore]
    row = _row_digest(columns)
    parts = [F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = [F.sum(part).cast("string") for part in parts]
    return df.groupBy(group.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws(":", *sums).alias("digest")
    )


def differing_groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """``part`` of the groups whose digests differ, or that only one side has."""
    rows = before.withColumn("_side", F.lit(-1)).unionByName(after.withColumn("_side", F.lit(1)))
    balance = rows.groupBy("part", "n", "digest").agg(F.sum("_side").alias("_side"))
    return balance.where(F.col("_side") != 0).select("part").distinct()


def snapshot_changes(
    before: DataFrame, after: DataFrame, ignore: Sequence[str] = ("updated_at",)
) -> DataFrame:
    """Rows in only one of two snapshots, counted by side.

    Both are counted against each other in one shuffle of row digests.
    """
    columns = [c for c in before.columns if c not in ignore]
    digest = _row_digest(columns)
    rows = before.select(digest.alias("row"), F.lit(-1).alias("n")).unionByName(
        after.select(digest.alias("row"), F.lit(1).alias("n"))
    )
    balance = rows.groupBy("row").agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    return balance.groupBy(
        F.when(F.col("n") > 0, "added").otherwise("removed").alias("side")
    ).agg(F.sum(F.abs("n")).alias("n"))
