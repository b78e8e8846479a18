"""Loads from a stream: equal to batch loads, and exactly once."""

from __future__ import annotations

import os

import pytest

from catalith.plans import curate
from catalith.session import scratch_path
from catalith.sources import snapshots
from catalith.sources.snapshots import SnapshotTable, buckets_for
from catalith.streaming import load as stream_load
from tests.conftest import rows
from tests.test_load import DAY1, FIRST, SCHEMA

SECOND = [
    (0, "HEAT", 1995, "Michael", 90.0, 8.4, [5.0, 5.0]),
    (1, "New", 2020, "N", 70.0, 7.0, [6.0, 6.0]),
    (2, "new", 2020, "Last", 71.0, 7.0, [7.0, 7.0]),
]
THIRD = [(0, "new", 2020, "Later", 72.0, 7.0, [1.0, 7.0]), (1, "Fifth", 1999, "F", 1.0, 1.0, [0.5, 7.0])]


def arrive(spark, folder, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def start(spark, folder, table, checkpoint, **options):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    options = {"clock": lambda: DAY1, **options}
    stream_load.upsert_stream(source, table, checkpoint, "0.1.0", **options).awaitTermination()


def content(table):
    return rows(table.read().drop("created_at", "updated_at"), "id")


@pytest.fixture
def arrived(spark, shared):
    folder = scratch_path(spark, "arrived")
    for part in (FIRST, SECOND, THIRD):
        arrive(spark, folder, part)
    return folder, SnapshotTable(spark, scratch_path(spark, "table")), scratch_path(spark, "state")


def test_stream_equals_batch_loads(spark, arrived):
    folder, table, state = arrived
    reports = {}
    start(spark, folder, table, state, on_report=lambda n, report: reports.update({n: report.count()}))
    other = SnapshotTable(spark, scratch_path(spark, "other"))
    for part in (FIRST, SECOND, THIRD):
        curate.load(spark.createDataFrame(part, SCHEMA), other, "0.1.0", DAY1)
    assert content(table) == content(other) and table.versions() == [1, 2, 3]
    assert sorted(reports) == [0, 1, 2]
    arrive(spark, folder, [(0, "Heat", 1986, "again", 2.0, 2.0, [1.0, 1.0])])
    start(spark, folder, table, state)
    assert table.versions() == [1, 2, 3, 4]
    assert {r["director"] for r in content(table)} == {"Michael", "again", "Later", "F"}


def test_a_batch_offered_again_is_recognised(spark, arrived):
    folder, table, state = arrived
    start(spark, folder, table, state)
    before = content(table)
    # The query stopped after the load, before it noted that the batch was done.
    for name in ("2", ".2.crc"):
        os.remove(f"{state.removeprefix('file:')}/commits/{name}")
    asked = []
    start(spark, folder, table, state, prepare=lambda df, n: asked.append(n) or df)
    assert table.versions() == [1, 2, 3] and content(table) == before and asked == []


def test_a_batch_that_failed_is_loaded_once(spark, arrived, monkeypatch):
    folder, table, state = arrived
    write, calls = SnapshotTable._commit, []

    def failing(self, version, text):
        calls.append(version)
        if len(calls) == 2:
            raise OSError("lost before the commit")
        return write(self, version, text)

    monkeypatch.setattr(SnapshotTable, "_commit", failing)
    with pytest.raises(Exception, match="lost before the commit"):
        start(spark, folder, table, state)
    assert table.versions() == [1]
    start(spark, folder, table, state)
    assert table.versions() == [1, 2, 3] and calls == [1, 2, 2, 3]
    assert {r["title"]: r["director"] for r in content(table)}["new"] == "Later"


def test_two_queries_have_ledgers_of_their_own(spark, arrived):
    folder, table, state = arrived
    start(spark, folder, table, state, source="a")
    start(spark, folder, table, scratch_path(spark, "state-b"), source="b")
    assert len(table.versions()) == 6
    assert table.last_batch("a") == table.last_batch("b") == 2 and table.last_batch("c") is None


def test_an_empty_batch_is_noted(spark, shared):
    table = SnapshotTable(spark, scratch_path(spark, "table"))
    empty = spark.createDataFrame([], SCHEMA)
    version, report = curate.load(empty, table, "0", DAY1, batch_of=("q", 0))
    assert version == 1 and report is not None and table.read().count() == 0 and table.last_batch("q") == 0
    assert curate.load(empty, table, "0", DAY1, batch_of=("q", 0)) == (1, None)


def test_tables_get_buckets_by_their_size(spark, shared, monkeypatch):
    assert [buckets_for(n) for n in (0, 1, 1_600_000, 1_700_000, 10**9)] == [16, 16, 16, 32, 16384]
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 4)
    table = SnapshotTable(spark, scratch_path(spark, "table"))

    def films(numbers):
        return spark.createDataFrame([(i, f"film {i}", 2000, "x", 1.0, 1.0, [1.0]) for i in numbers], SCHEMA)

    curate.load(films(range(200)), table, "0", DAY1)
    assert table.buckets() == 64 and table.rows() == 200
    curate.load(films(range(190, 260)), table, "0", DAY1)
    assert table.buckets() == 64 and table.rows() == table.read().count() == 260
    curate.load(films(range(1_200)), table, "0", DAY1)
    assert table.buckets() == 512 and table.rows() == table.read().count() == 1_200
    curate.load(films([7]), table, "0", DAY1)
    before, after = table.manifest(3)["writes"], table.manifest(4)["writes"]
    assert sum(before[b] != after[b] for b in before) == 1 and table.rows() == 1_200
