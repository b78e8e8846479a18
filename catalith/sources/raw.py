"""Reading the raw table: every column as text, typed by cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith import fixed


def read_raw(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    headers: Sequence[str] = fixed.RAW_HEADERS,
    **options: str,
) -> DataFrame:
    """Raw rows under their displayed headers, plus ``row_pos``.

    No schema inference, so a number in a text column stays what was written.
    Text formats accept a header spaced or underscored. Name the ``headers`` a
    source has when it lacks some: a column it lacks is then left out, not empty.
    """
    if fmt in ("parquet", "orc"):
        df = spark.read.format(fmt).options(**options).load(path)
        cells = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    elif fmt == "csv":
        # By position in the file, under the names its first line gives.
        df = spark.read.options(header="true", inferSchema="false", **options).csv(path)
        cells = [F.col(f"`{c}`") for c in df.columns]
    else:
        both = dict.fromkeys(name for h in headers for name in (h, h.replace(" ", "_")))
        schema = T.StructType([T.StructField(name, T.StringType()) for name in both])
        df = spark.read.format(fmt).schema(schema).options(**options).load(path)
        cells = [
            F.coalesce(F.col(f"`{h}`"), F.col(f"`{h.replace(' ', '_')}`")).alias(h)
            for h in headers
        ]
    return with_position(df, cells)


def with_position(df: DataFrame, cells: Sequence[Column], column: str = "row_pos") -> DataFrame:
    """``cells`` of a table just read from files, and the position in the input.

    Positions follow file path, split and row, however Spark packs splits into
    tasks: splits are numbered first (a scan of no columns), and a row's place within its split
    fills the lower 33 bits. A retried task gives the same numbers again.
    """
    where = [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    ]
    splits = df.select(*where).distinct()
    numbers = splits.select(
        "_file", "_start", (F.row_number().over(Window.orderBy("_file", "_start")) - 1).alias("_split")
    )
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select(*cells, *where, place.alias("_place"))
    placed = rows.join(numbers, ["_file", "_start"])
    position = F.col("_split").cast("bigint") * F.lit(1 << 33) + F.col("_place")
    return placed.withColumn(column, position).drop("_file", "_start", "_split", "_place")
