"""Mergeable states: quantile sketches, distinct counts and digests of buckets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalith.operators import stats, traffic
from catalith.plans.curate import load
from catalith.session import scratch_path
from catalith.sources.snapshots import SnapshotTable
from catalith.sources.states import LoadStates
from catalith.streaming import traffic as stream
from tests.conftest import rows
from tests.test_load import DAY1, DAY2, SCHEMA as ITEM
from tests.test_traffic import log, run_stream, written


def rank_of(values, q):
    return sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)


def test_sketches_of_panes_merge_to_windows_of_any_length(spark, shared):
    rng = random.Random(4)
    entries = [(rng.randrange(7200), 1, rng.choice("ab"), rng.lognormvariate(-2, 1), False) for _ in range(4_000)]
    source, batch = written(spark, [*entries, (7_100, 1, "b", None, False)], 3)
    panes = traffic.latency_sketches(batch)
    for window, slide, parts in (("1 hour", None, 2), ("30 minutes", "10 minutes", 14)):
        found = rows(traffic.sketched_quantiles(traffic.merged_sketches(panes, window, slide)))
        assert len({r["window_start"] for r in found}) == parts and {r["p"] for r in found} == {0.5, 0.95, 0.99}
        for r in found:
            start = (r["window_start"].hour - 12) * 3600 + r["window_start"].minute * 60
            length = traffic.seconds_in(window)
            values = [s for at, _, tool, s, _ in entries if tool == r["tool"] and start <= at < start + length]
            low, high = rank_of(values, r["quantile"])
            assert r["requests"] == len(values) and low - 0.01 <= r["p"] <= high + 0.01 + 1 / len(values)
    # Panes that a stream has closed merge in the same way.
    closed = run_stream(spark, source, batch.schema, stream.latency_sketches)
    counts = rows(traffic.merged_sketches(closed, "1 hour").select("window_start", "tool", "requests"), "window_start", "tool")
    assert [r["requests"] for r in counts[:2]] == [sum(e[0] < 3600 and e[2] == t for e in entries) for t in "ab"]


def test_statistics_of_loads_merge(spark, shared):
    rng = random.Random(6)
    schema = "title string, release_year int, major_genre string, imdb_rating double"
    films = [(f"Film {rng.randrange(900)}", rng.randrange(1950, 2020), rng.choice(["a", "b", None]), rng.choice([None, 5.5, 7.0])) for _ in range(3_000)]
    states = LoadStates(spark, scratch_path(spark, "states"))
    with pytest.raises(ValueError, match="no load"):
        states.read()
    for number, part in enumerate((films[:1000], films[1000:2500], films[1000:2500], films[2500:])):
        number = min(number, 2) if number < 3 else 3
        states.add(1 if number == 2 else number, stats.stats_state(spark.createDataFrame(part, schema)))
    whole = spark.createDataFrame(films, schema)
    got, exact = stats.merged_stats(states.read()).first(), stats.dataset_stats(whole).first()
    for name in ("total_movies", "genres", "year_min", "year_max"):
        assert got[name] == exact[name]
    assert got["avg_imdb_rating"] == pytest.approx(exact["avg_imdb_rating"])
    assert got["titles"] == pytest.approx(len({(f[0], f[1]) for f in films}), rel=0.02)
    empty = stats.merged_stats(stats.stats_state(whole.limit(0))).first()
    assert empty["total_movies"] == 0 and empty["genres"] == 0 and empty["avg_imdb_rating"] is None


def test_only_differing_buckets_are_compared_row_by_row(spark, shared):
    def films(numbers, director):
        return spark.createDataFrame([(i, f"film {i}", 2000, director, 1.0, 1.0, [1.0]) for i in numbers], ITEM)

    table = SnapshotTable(spark, scratch_path(spark, "table"))
    load(films(range(300), "x"), table, "0", DAY1)
    load(films(range(300), "x"), table, "0", DAY2)  # all files anew, the same rows
    assert table.changed_buckets(1, 2) == [] and rows(table.changes(1, 2)) == []
    assert table.changed_buckets(1, 2, ignore=()) == list(range(16))
    load(films([7], "y").unionByName(films([1_000], "y")), table, "0", DAY2)
    places = table.read().where(F.col("director") == "y").select(table.bucket_of(F.col("id"))).distinct()
    assert table.changed_buckets(2, 3) == sorted(r[0] for r in places.collect())
    changes = table.changes(2, 3)
    assert {r["side"]: r["n"] for r in changes.collect()} == {"added": 2, "removed": 1}
    assert {f.rsplit("/", 2)[1] for f in changes.inputFiles()} <= {f"bucket={b}" for b in table.changed_buckets(2, 3)}
    everything = stats.snapshot_changes(table.read(2), table.read(3))
    assert rows(everything, "side") == rows(changes, "side")


def test_digests_do_not_hang_on_order_but_on_every_value(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (2, "b", 1.0)], "k int, s string, v double")
    digest = lambda d: rows(stats.group_digests(d, F.lit(0)))
    same = digest(df.orderBy(F.desc("k")).repartition(3))
    assert digest(df) == same
    for other in (df.distinct(), df.withColumn("v", F.coalesce("v", F.lit(0.0))), df.withColumn("s", F.lit("a"))):
        assert digest(other) != same
    assert rows(stats.differing_groups(stats.group_digests(df, F.col("k")), stats.group_digests(df.where("k = 2"), F.col("k")))) == [{"part": 1}]
