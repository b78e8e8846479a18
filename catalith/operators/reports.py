"""Stage reports.

A report is a DataFrame of counters in long form, so that reports of several
stages are one ``unionByName`` and go to JSON or Parquet as they are.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One counter: (metric, field, aggregate expression or None, note or None).
Counter = tuple[str, str, "Column | None", "str | None"]


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def long_report(df: DataFrame, stage: str, counters: Iterable[Counter]) -> DataFrame:
    """All counters in one pass over ``df``, one row per counter."""
    counters = list(counters)
    measured = [c for c in counters if c[2] is not None]
    one_row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[value.cast("double").alias(f"c{i}") for i, (_, _, value, _) in enumerate(measured)],
    )
    position = {id(c): i for i, c in enumerate(measured)}
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(field).alias("field"),
            (F.col(f"c{position[id(counter)]}") if value is not None else F.lit(None))
            .cast("double")
            .alias("value"),
            F.lit(note).cast("string").alias("note"),
        )
        for counter in counters
        for metric, field, value, note in [counter]
    ]
    return one_row.select(F.lit(stage).alias("stage"), F.inline(F.array(*rows)))


def union_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def nested_report(report: DataFrame) -> DataFrame:
    """One row per stage and metric: its counters as a map, zeros left out.

    A report has as many rows as counters, so the groups are small.
    """
    shown = report.where((F.col("value") != 0) | (F.col("field") == "") | F.col("note").isNotNull())
    return shown.groupBy("stage", "metric").agg(
        F.max(F.when(F.col("field") == "", F.col("value"))).alias("total"),
        F.map_from_entries(
            F.sort_array(
                F.collect_list(
                    F.when(
                        (F.col("field") != "") & F.col("value").isNotNull(),
                        F.struct("field", "value"),
                    )
                )
            )
        ).alias("by_field"),
        F.map_from_entries(
            F.sort_array(
                F.collect_list(F.when(F.col("note").isNotNull(), F.struct("field", "note")))
            )
        ).alias("notes"),
    )
