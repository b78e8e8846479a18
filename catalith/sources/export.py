"""Analytics export and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions.vectors import checked_vector, parse_vector
from catalith.operators.dedup import is_text
from catalith.operators.reports import nested_report


def embedded_count(df: DataFrame) -> int:
    return df.where(F.col("embedding").isNotNull()).count()


def export_rows(df: DataFrame, dim: int = fixed.EMBEDDING_DIM) -> DataFrame:
    """The export columns of embedded rows, the vector as a list of ``dim`` floats."""
    missing = [c for c in fixed.EXPORT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks columns of the export: {missing}")
    vector = F.col("embedding")
    shaped = {
        "id": F.col("id").cast("string"),
        "imdb_rating": F.col("imdb_rating").cast("double"),
        "rt_rating": F.col("rt_rating").cast("int"),
        "embedding": (
            parse_vector(vector, dim)
            if is_text(df, "embedding")
            else checked_vector(vector.cast("array<float>"), dim)
        ),
    }
    return df.where(vector.isNotNull()).select(
        *[shaped.get(c, F.col(c)).alias(c) for c in fixed.EXPORT_COLUMNS]
    )


def write_export(df: DataFrame, path: str, dim: int = fixed.EMBEDDING_DIM) -> None:
    """Write the export as Parquet; an empty one is an error."""
    rows = export_rows(df, dim)
    if df.where(F.col("embedding").isNotNull()).isEmpty():
        raise ValueError("nothing to export: no row has a vector")
    rows.write.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Stage reports as JSON lines, one per stage and metric."""
    nested_report(report).coalesce(1).write.json(path)
