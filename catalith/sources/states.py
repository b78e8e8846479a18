"""Counts that are added up over loads, so that statistics do not scan what was loaded before.

A state is a row of key columns and a count ``n``. Each load leaves a folder of such rows under its
number; all folders together are the state of the table. Rows that a load replaces are taken away by
negative counts. A load that is repeated replaces its folder, so it counts once.

``compact`` sums folders up into one under the number of the last of them. A folder counts when Spark's
writer has finished it, and one that was summed up does not count any more, whether it is
deleted yet or not; so a job that fails half-way changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.session import child_names, delete_path


def finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the loads below a folder that Spark's writer has finished."""
    names = [n for n in child_names(spark, folder) if n.isdigit()]
    return sorted(int(n) for n in names if "_SUCCESS" in child_names(spark, f"{folder}/{n}"))


class LoadStates:
    """A small table per load, such as one row of mergeable sketches; all of them are read together."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self.path = path.rstrip("/")

    def add(self, load: int, state: DataFrame) -> None:
        """Keep the state of a load; that of a repeated load replaces it."""
        state.write.mode("overwrite").parquet(f"{self.path}/{load}")

    def read(self) -> DataFrame:
        done = finished(self._spark, self.path)
        if not done:
            raise ValueError(f"no load has left a state in {self.path}")
        return self._spark.read.parquet(*(f"{self.path}/{n}" for n in done))


class CountStates:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]) -> None:
        self._spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)

    def _done(self, kind: str) -> list[int]:
        return finished(self._spark, f"{self.path}/{kind}")

    def loads(self) -> tuple[int | None, list[int]]:
        """The load up to which counts are summed up, and those after it."""
        base = max(self._done("sums"), default=None)
        return base, [n for n in self._done("loads") if base is None or n > base]

    def add(self, load: int, added: DataFrame, removed: DataFrame | None = None) -> None:
        """Count the rows of a load (``keys`` columns), less those it replaces."""
        base = max(self._done("sums"), default=None)
        if base is not None and load <= base:
            return  # repeated after it was summed up
        counted = added.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        if removed is not None:
            gone = removed.groupBy(*self.keys).agg((-F.count(F.lit(1))).alias("n"))
            counted = self._summed(counted.unionByName(gone))
        counted.write.mode("overwrite").parquet(f"{self.path}/loads/{load}")

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def read(self) -> DataFrame:
        """``keys, n`` of everything loaded so far, each key once."""
        base, after = self.loads()
        folders = ([f"sums/{base}"] if base is not None else []) + [f"loads/{n}" for n in after]
        if not folders:
            raise ValueError(f"no load has left a state in {self.path}")
        parts = [self._spark.read.parquet(f"{self.path}/{folder}") for folder in folders]
        return self._summed(reduce(DataFrame.unionByName, parts))

    def compact(self) -> int | None:
        """Sum up all finished loads; the number of the last one."""
        base, after = self.loads()
        if not after:
            return base
        self.read().write.mode("overwrite").parquet(f"{self.path}/sums/{after[-1]}")
        for number in self._done("sums"):
            if number < after[-1]:
                delete_path(self._spark, f"{self.path}/sums/{number}")
        for number in self._done("loads"):
            if number <= after[-1]:
                delete_path(self._spark, f"{self.path}/loads/{number}")
        return after[-1]
