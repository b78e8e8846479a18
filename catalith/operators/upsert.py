"""Keyed load: bind to the stored types, last row of a key wins, merge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions.text import is_blank
from catalith.functions.values import half_even
from catalith.operators.dedup import EXAMPLES, keep_first
from catalith.operators.reports import count_where, long_report, union_reports
from catalith.session import fits_broadcast, settle

# A batch of at most this many rows, vectors included, is broadcast to the table.
SMALL_BATCH = 10_000
_KEY = ("_title_key", "release_year")
_NO_KEY = "no natural key (title/release_year)"
_FLAGS = tuple(c for c in fixed.STORED_TYPES if c.endswith("_imputed"))
_AUDIT = ("created_at", "updated_at")


def has_natural_key() -> Column:
    return ~is_blank(F.col("title")) & F.col("release_year").isNotNull()


def has_vector() -> Column:
    return F.col("embedding").isNotNull() & (F.size("embedding") > 0)


def item_id(title: Column, year: Column) -> Column:
    """An id in UUID form that depends on the natural key alone.

    A retried task gives a row the same id again, which a random one would not.
    """
    digest = F.md5(F.concat_ws("#", F.lower(title), year.cast("string")))
    return F.regexp_replace(digest, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")


def attach_vectors(rows: DataFrame, vectors: DataFrame, on: str = "row_pos") -> DataFrame:
    """Join rows with their vectors; a row or vector left over is an error."""
    pairs = settle(
        rows.withColumn("_row", F.lit(True)).join(
            vectors.withColumn("_vector", F.lit(True)), on, "full_outer"
        ),
        "pairs",
    )
    odd = pairs.agg(
        count_where(F.col("_vector").isNull()).alias("rows"),
        count_where(F.col("_row").isNull()).alias("vectors"),
    ).first()
    if odd["rows"] or odd["vectors"]:
        raise ValueError(
            f"{odd['rows']} rows without a vector and {odd['vectors']} vectors without a row"
        )
    return pairs.drop("_row", "_vector")


def bind(df: DataFrame, pipeline_version: str) -> DataFrame:
    """Columns and types of the stored table, but for id and audit columns."""
    bound = []
    for column, kind in fixed.STORED_TYPES.items():
        if column in ("id", *_AUDIT):
            continue
        if column == "pipeline_version":
            value = F.lit(pipeline_version)
        elif column not in df.columns:
            value = F.lit(False) if column in _FLAGS else F.lit(None)
        elif column in _FLAGS:
            value = F.coalesce(F.col(column), F.lit(False))
        elif kind in ("int", "bigint"):
            value = half_even(F.col(column).cast("double"), 0)
        else:
            value = F.col(column)
        bound.append(value.cast(kind).alias(column))
    return df.select(*bound)


def loadable(df: DataFrame, order: str = "row_pos") -> DataFrame:
    """Rows with a key and a vector; of one key, the last in input order."""
    fit = df.where(has_natural_key() & has_vector()).withColumn(
        "_title_key", F.lower("title")
    )
    keys = [F.col("_title_key"), F.col("release_year")]
    return keep_first(fit, keys, [F.col(order).desc()]).drop("_title_key")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_title_key", F.lower("title"))


def merge(
    target: DataFrame | None,
    batch: DataFrame,
    run_at: dt.datetime,
    small_batch: int = SMALL_BATCH,
) -> DataFrame:
    """The table after the batch. Both sides hold a key at most once.

    An update takes every column of the batch but the key, the spelling of the
    title and the id, which stay as first stored. A small batch is broadcast, so
    the table is not shuffled; a large one is merged by a full outer join.
    """
    moment = F.lit(run_at).cast("timestamp")
    new = _keyed(batch).withColumns(
        {"id": item_id(F.col("title"), F.col("release_year")), "_new": F.lit(True)}
    )
    added = {"created_at": moment, "updated_at": moment}
    if target is None:
        return new.withColumns(added).select(*fixed.STORED_TYPES)
    old = _keyed(target).withColumn("_old", F.lit(True))

    def merged(pairs: DataFrame) -> DataFrame:
        fresh = F.col("n._new").isNotNull()
        known = F.col("o._old").isNotNull()
        values = {}
        for column in fixed.STORED_TYPES:
            if column in ("id", "title", "release_year"):
                value = F.coalesce(f"o.{column}", f"n.{column}")
            elif column == "created_at":
                value = F.when(known, F.col("o.created_at")).otherwise(moment)
            elif column == "updated_at":
                value = F.when(fresh, moment).otherwise(F.col("o.updated_at"))
            else:
                value = F.when(fresh, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}"))
            values[column] = value
        return pairs.select(*[value.alias(column) for column, value in values.items()])

    on = (F.col("o._title_key") == F.col("n._title_key")) & (
        F.col("o.release_year") == F.col("n.release_year")
    )
    if not fits_broadcast(batch, small_batch):
        return merged(old.alias("o").join(new.alias("n"), on, "full_outer"))
    new = F.broadcast(new)
    kept = merged(old.alias("o").join(new.alias("n"), on, "left"))
    # Keys of the batch that are stored already: no more than the batch has.
    stored = F.broadcast(old.select(*_KEY).join(new.select(*_KEY), list(_KEY), "left_semi"))
    inserted = (
        new.join(stored, list(_KEY), "left_anti").withColumns(added).select(*fixed.STORED_TYPES)
    )
    return kept.unionByName(inserted)


def skipped_examples(df: DataFrame, order: str = "row_pos", n: int = EXAMPLES) -> DataFrame:
    """The first rows a load skips for want of a key."""
    return (
        df.where(~has_natural_key())
        .orderBy(order)
        .limit(n)
        .select(
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce(F.col("release_year").cast("string"), F.lit("")).alias("release_year"),
            F.lit(_NO_KEY).alias("reason"),
        )
    )


def load_report(offered: DataFrame, table_after: DataFrame, pipeline_version: str) -> DataFrame:
    """Rows in, written, skipped by cause, and in the table afterwards.

    Written counts every applied row, also one that a later row of the same key
    replaced.
    """
    keyed = has_natural_key()
    everything = F.count(F.lit(1))
    return union_reports(
        long_report(
            offered,
            "load",
            [
                ("rows_in", "", everything, None),
                ("rows_written", "", count_where(keyed & has_vector()), None),
                ("rows_skipped_no_key", "", count_where(~keyed), None),
                ("rows_skipped_no_embedding", "", count_where(keyed & ~has_vector()), None),
                ("pipeline_version", "", None, pipeline_version),
            ],
        ),
        long_report(table_after, "load", [("table_total_after", "", everything, None)]),
    )
