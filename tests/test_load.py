from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalith import fixed
from catalith.operators import stats, upsert
from catalith.operators.search import canonical_id
from catalith.plans.curate import load
from catalith.session import scratch_path
from catalith.sources import export
from catalith.sources.snapshots import SnapshotTable, StaleBase
from tests.conftest import rows

DAY1 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
DAY2 = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
SCHEMA = (
    "row_pos int, title string, release_year int, director string, rt_rating double, "
    "imdb_rating double, embedding array<float>"
)
FIRST = [
    (0, "Heat", 1995, "M", 87.5, 8.3, [1.0, 2.0]),
    (1, "Heat", 1986, "R", None, 5.0, [0.0, 2.0]),
    (2, None, 2006, "X", 1.0, 1.0, [3.0, 2.0]),
    (3, "  ", 2006, "X", 1.0, 1.0, [3.0, 2.0]),
    (4, "Solaris", None, "T", 1.0, 1.0, [3.0, 2.0]),
    (5, "No vector", 2000, "T", 1.0, 1.0, []),
    (6, "No vector either", 2000, "T", 1.0, 1.0, None),
]


@pytest.fixture
def table(spark):
    return SnapshotTable(spark, scratch_path(spark, "table"))


def stored(table):
    return {(r["title"], r["release_year"]): r for r in rows(table.read())}


def report_of(report):
    return {r["metric"]: r["value"] for r in report.collect()}


def test_first_load(spark, table):
    version, report = load(spark.createDataFrame(FIRST, SCHEMA), table, "0.1.0", DAY1)
    assert version == 1
    got = stored(table)
    assert set(got) == {("Heat", 1995), ("Heat", 1986)}
    heat = got["Heat", 1995]
    assert heat["rt_rating"] == 88 and float(heat["imdb_rating"]) == 8.3
    assert heat["rt_rating_imputed"] is False and heat["pipeline_version"] == "0.1.0"
    counts = report_of(report)
    assert counts["rows_in"] == 7
    assert counts["rows_written"] == 2
    assert counts["rows_skipped_no_key"] == 3
    assert counts["rows_skipped_no_embedding"] == 2
    assert counts["table_total_after"] == 2
    assert dict(table.read().dtypes) == fixed.STORED_TYPES


@pytest.mark.parametrize("small_batch", [10_000, 0])
def test_update_keeps_id_title_and_creation(spark, table, monkeypatch, small_batch):
    merge = upsert.merge
    monkeypatch.setattr(
        upsert, "merge", lambda t, b, at: merge(t, b, at, small_batch=small_batch)
    )
    load(spark.createDataFrame(FIRST, SCHEMA), table, "0.1.0", DAY1)
    before = stored(table)
    second = [
        (0, "HEAT", 1995, "Michael", 90.0, 8.4, [5.0, 5.0]),
        (1, "New", 2020, "N", 70.0, 7.0, [6.0, 6.0]),
        (2, "new", 2020, "Last", 71.0, 7.0, [7.0, 7.0]),
    ]
    load(spark.createDataFrame(second, SCHEMA), table, "0.2.0", DAY2)
    after = stored(table)
    assert set(after) == {("Heat", 1995), ("Heat", 1986), ("new", 2020)}
    heat = after["Heat", 1995]
    assert heat["id"] == before["Heat", 1995]["id"]
    assert (heat["director"], heat["rt_rating"], heat["pipeline_version"]) == ("Michael", 90, "0.2.0")
    assert heat["created_at"] == before["Heat", 1995]["created_at"]
    assert heat["updated_at"] - heat["created_at"] == dt.timedelta(days=1)
    assert after["Heat", 1986] == before["Heat", 1986]
    assert after["new", 2020]["director"] == "Last"
    assert table.versions() == [1, 2]
    assert table.read(1).count() == 2
    assert rows(stats.repeated_keys(table.read())) == []


def test_rerun_changes_nothing_but_the_time(spark, table):
    df = spark.createDataFrame(FIRST, SCHEMA)
    load(df, table, "0.1.0", DAY1)
    load(df, table, "0.1.0", DAY2)
    assert rows(stats.snapshot_changes(table.read(1), table.read(2))) == []
    changed = stats.snapshot_changes(table.read(1), table.read(2), ignore=())
    assert {r["side"]: r["n"] for r in changed.collect()} == {"added": 2, "removed": 2}


def test_an_unfinished_load_is_not_seen(spark, table):
    load(spark.createDataFrame(FIRST, SCHEMA), table, "0.1.0", DAY1)
    table.read().limit(1).write.parquet(f"{table.path}/data/abandoned/bucket=0")
    assert table.versions() == [1]
    assert table.read().count() == 2
    assert table.write(table.read(), based_on=1) == 2
    assert table.read().count() == 2


def batch(spark, *rows_of_it):
    return spark.createDataFrame(rows_of_it, SCHEMA)


def test_a_write_on_a_stale_base_fails_and_a_new_merge_keeps_all_rows(spark, table):
    load(batch(spark, (0, "a", 2000, "x", 1.0, 1.0, [1.0])), table, "0", DAY1)
    base = table.latest()
    plans = []
    for title in ("b", "c"):
        new = upsert.bind(upsert.loadable(batch(spark, (0, title, 2000, "x", 1.0, 1.0, [1.0]))), "0")
        plans.append(upsert.merge(table.read(base), new, DAY2))
    assert table.write(plans[0], base) == 2
    with pytest.raises(StaleBase):
        table.write(plans[1], base)
    load(batch(spark, (0, "c", 2000, "x", 1.0, 1.0, [1.0])), table, "0", DAY2)
    assert {title for title, _ in stored(table)} == {"a", "b", "c"}
    assert table.versions() == [1, 2, 3]


def test_two_commits_of_one_number_cannot_both_stand(table):
    table._commit(1, "{}")
    with pytest.raises(StaleBase):
        table._commit(1, "{}")


def test_a_load_merges_again_when_another_came_first(spark, table, monkeypatch):
    load(batch(spark, (0, "a", 2000, "x", 1.0, 1.0, [1.0])), table, "0", DAY1)
    merge, calls = upsert.merge, []

    def slow(target, new, at):
        calls.append(1)
        planned = merge(target, new, at)
        if len(calls) == 1:  # another load is committed between plan and write
            monkeypatch.setattr(upsert, "merge", merge)
            load(batch(spark, (0, "b", 2000, "x", 1.0, 1.0, [1.0])), table, "0", DAY1)
            monkeypatch.setattr(upsert, "merge", slow)
        return planned

    monkeypatch.setattr(upsert, "merge", slow)
    version, _ = load(batch(spark, (0, "c", 2000, "x", 1.0, 1.0, [1.0])), table, "0", DAY2)
    assert version == 3 and len(calls) == 2
    assert {title for title, _ in stored(table)} == {"a", "b", "c"}


def test_untouched_buckets_keep_their_files(spark, table):
    many = [(i, f"film {i}", 2000, "x", 1.0, 1.0, [1.0]) for i in range(200)]
    load(batch(spark, *many), table, "0", DAY1)
    load(batch(spark, (0, "film 3", 2000, "new", 1.0, 1.0, [1.0])), table, "0", DAY2)
    before, after = table.manifest(1)["writes"], table.manifest(2)["writes"]
    assert before.keys() == after.keys() and len(before) > 4
    assert sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 200 and stored(table)["film 3", 2000]["director"] == "new"
    assert table.forget(keep=1) == [1]
    assert table.read().count() == 200 and table.versions() == [2]


def test_point_lookups_read_one_bucket(spark, table):
    many = [(i, f"Film {i}", 2000, "x", 1.0, 1.0, [1.0]) for i in range(200)]
    load(batch(spark, *many), table, "0", DAY1)
    wanted = stored(table)["Film 7", 2000]["id"]
    found = table.by_id(wanted)
    assert [r["title"] for r in rows(found)] == ["Film 7"]
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 1
    assert [r["id"] for r in rows(table.by_title("fILM 7"))] == [wanted]
    assert rows(table.by_id("x")) == [] and rows(table.by_title("none")) == []
    assert dict(table.by_title("film 7").dtypes) == fixed.STORED_TYPES


def test_vectors_that_come_apart_are_joined_or_fail_the_load(spark, table):
    whole = batch(spark, (0, "a", 2000, "x", 1.0, 1.0, [1.0]), (1, "b", 2000, "x", 1.0, 1.0, [2.0]))
    vectors = whole.select("row_pos", "embedding")
    load(whole.drop("embedding"), table, "0", DAY1, vectors=vectors)
    assert stored(table)["b", 2000]["embedding"] == [2.0]
    with pytest.raises(ValueError, match="1 rows without a vector"):
        load(whole.drop("embedding"), table, "0", DAY1, vectors=vectors.limit(1))
    assert table.versions() == [1]


def test_skipped_examples(spark):
    got = rows(upsert.skipped_examples(spark.createDataFrame(FIRST, SCHEMA)))
    assert [(r["title"], r["release_year"]) for r in got] == [
        ("", "2006"),
        ("  ", "2006"),
        ("Solaris", ""),
    ]


def test_ids_are_repeatable_and_ignore_case(spark):
    df = spark.createDataFrame([("Heat", 1995), ("HEAT", 1995), ("Heat", 1996)], "t string, y int")
    ids = [r[0] for r in df.select(upsert.item_id(F.col("t"), F.col("y"))).collect()]
    assert ids[0] == ids[1] != ids[2]
    shape = df.select(canonical_id(upsert.item_id(F.col("t"), F.col("y"))))
    assert [r[0] for r in shape.collect()] == ids


def test_vectors_must_match_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "row_pos int, title string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "row_pos int, embedding array<float>")
    assert upsert.attach_vectors(left, vectors).count() == 2
    with pytest.raises(ValueError, match="1 rows without a vector"):
        upsert.attach_vectors(left, vectors.where("row_pos = 1"))


def exportable(spark, vector, kind="array<float>"):
    names = [c for c in fixed.EXPORT_COLUMNS if c != "embedding"]
    types = {"decade": "int", "imdb_rating": "decimal(3,1)", "rt_rating": "bigint"}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in names)
    data = [(*[None] * len(names), vector), (*[None] * len(names), None)]
    return spark.createDataFrame(data, f"{schema}, embedding {kind}")


def test_export(spark):
    path = scratch_path(spark, "export")
    export.write_export(exportable(spark, [1.0, 2.0]), path, dim=2)
    back = spark.read.parquet(path)
    assert tuple(back.columns) == fixed.EXPORT_COLUMNS
    assert [r["embedding"] for r in rows(back)] == [[1.0, 2.0]]
    assert dict(back.dtypes)["imdb_rating"] == "double"


def test_export_parses_text_vectors_and_refuses_bad_input(spark):
    text = exportable(spark, "[0.5, -7.5E-4,2]", "string")
    assert rows(export.export_rows(text, 3))[0]["embedding"] == pytest.approx([0.5, -0.00075, 2.0])
    with pytest.raises(Exception, match="embedding length is not 4"):
        rows(export.export_rows(text, 4))
    with pytest.raises(ValueError, match="lacks columns"):
        export.export_rows(text.drop("decade"), 3)
    with pytest.raises(ValueError, match="nothing to export"):
        export.write_export(text.where("embedding is null"), scratch_path(spark, "none"), 3)
    assert export.embedded_count(text) == 1


def test_search_filters_reach_the_scan_of_the_stored_table(spark, table):
    from catalith.operators import search

    load(spark.createDataFrame(FIRST, SCHEMA), table, "0.1.0", DAY1)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = search.hybrid_search(
        table.read(), [1.0, 2.0], search.Filters("Drama", 1990, mpaa_rating="R")
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") : plan.index("ReadSchema")]
    for filter_ in ("EqualTo(decade,1990)", "EqualTo(major_genre,Drama)", "EqualTo(mpaa_rating,R)"):
        assert filter_ in pushed
    assert "augmented_text" not in plan[plan.index("ReadSchema") :]
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
