from __future__ import annotations

import json
import os

import pytest

from catalith.operators import search
from catalith.plans.catalog import Catalog
from catalith.plans.curate import curate
from catalith.session import scratch_path
from catalith.sources.export import write_report
from catalith.sources.raw import read_raw
from catalith.sources.snapshots import SnapshotTable
from checks import queries as registered
from checks.compare import compare, connect
from checks.oracles import oracle_sql
from checks.model import hashing_model
from tests.conftest import rows


def write_lines(folder, records):
    path = os.path.join(folder, "raw.json")
    with open(path, "w") as out:
        for record in records:
            out.write(json.dumps(record) + "\n")
    return path


def test_raw_rows_are_text_in_order(spark, tmp_path):
    path = write_lines(
        tmp_path,
        [{"Title": 300, "US_Gross": 5, "Release Date": "Mar 9 2007"}, {"Title": "b", "US Gross": 0.5}],
    )
    got = rows(read_raw(spark, path), "row_pos")
    assert [r["Title"] for r in got] == ["300", "b"]
    assert [r["US Gross"] for r in got] == ["5", "0.5"]
    assert "Source" in got[0]
    few = read_raw(spark, path, headers=("Title",))
    assert few.columns == ["Title", "row_pos"]


def test_positions_follow_files_and_lines_whatever_the_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    wanted = []
    for k, count in enumerate((40, 400, 5, 120)):  # Spark packs the largest first
        titles = [f"{k}-{i:04d}" for i in range(count)]
        wanted += titles
        lines = "".join(json.dumps({"Title": t}) + "\n" for t in titles)
        (folder / f"{k}.json").write_text(lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = rows(read_raw(spark, str(folder), headers=("Title",)), "row_pos")
            assert [r["Title"] for r in got] == wanted
            assert len({r["row_pos"] for r in got}) == len(wanted)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_finished_job_leaves_only_what_it_returns(spark, tmp_path, shared):
    raw = read_raw(spark, write_lines(tmp_path, [{"Title": "A", "Release Date": "Jan 1 1999"}]))
    run = curate(raw, SnapshotTable(spark, f"{tmp_path}/table"), hashing_model(8), dim=8)
    assert run.augmented.count() == 1 and run.reports.count() > 10
    assert [name.endswith("-kept") for name in shared()] == [True]


def test_csv_keeps_its_own_headers(spark, tmp_path):
    path = os.path.join(tmp_path, "raw.csv")
    with open(path, "w") as out:
        out.write("IMDB_Rating,Title\n007,A\n")
    assert rows(read_raw(spark, path, "csv")) == [{"IMDB_Rating": "007", "Title": "A", "row_pos": 0}]


def test_job_end_to_end_and_again(spark, tmp_path):
    records = [
        {"Title": f"Film {i}", "Release Date": f"Jan {i % 27 + 1} {1980 + i}", "Major Genre": "Drama",
         "IMDB Rating": 5 + i % 4, "Worldwide Gross": i * 10_000_000}
        for i in range(20)
    ]
    records += [records[0], {"Title": "None", "Release Date": "Jan 1 1999"}]
    raw = read_raw(spark, write_lines(tmp_path, records))
    table = SnapshotTable(spark, scratch_path(spark, "table"))
    for version in (1, 2):
        run = curate(raw, table, hashing_model(16), dim=16)
        assert run.version == version
        assert table.read().count() == 20
    totals = {r["metric"]: r["value"] for r in run.reports.where("field = ''").collect()}
    assert totals["rows_in"] == 21 and totals["duplicates_removed"] == 1
    assert totals["rows_written"] == 20 and totals["table_total_after"] == 20
    stored = table.read()
    top = rows(search.similar_items(stored, stored.where("title = 'Film 3'").first()["id"], 3))
    assert len(top) == 3 and "Film 3" not in {r["title"] for r in top}

    path = scratch_path(spark, "reports")
    write_report(run.reports, path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    written = {(r["stage"], r["metric"]): r for r in lines}
    assert written["cleaning", "rows_out"]["total"] == 21


def test_dry_run_stops_before_embedding(spark, tmp_path):
    run = curate(read_raw(spark, write_lines(tmp_path, [{"Title": "A"}])))
    assert run.version is None
    assert "embedding" not in run.augmented.columns
    assert {r["stage"] for r in run.reports.collect()} == {"cleaning", "imputation", "augmentation"}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_its_sql(spark, duck, small, name):
    problem, _ = compare(spark, duck, registered.queries()[name], oracle_sql().get(name), small)
    assert not problem


def test_every_sql_has_a_query():
    assert set(oracle_sql()) == set(registered.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.count() > 0


def test_catalog_answers(spark, tmp_path):
    records = [
        {"Title": f"Film {i}", "Release Date": f"Jan 1 {1990 + i % 10}", "Major Genre": genre,
         "MPAA Rating": "R", "IMDB Rating": 5 + i % 5}
        for i, genre in enumerate(["Drama", "Action"] * 8)
    ]
    table = SnapshotTable(spark, scratch_path(spark, "table"))
    curate(read_raw(spark, write_lines(tmp_path, records)), table, hashing_model(16), dim=16)
    catalog = Catalog(table.read(), hashing_model(16), dim=16)

    found = rows(catalog.search_movies_by_description("highly rated drama of the 90s", top_k=99))
    assert found and all(r["major_genre"] == "Drama" and r["imdb_rating"] >= 7.5 for r in found)
    given = rows(catalog.search_movies_by_description("drama", genre_filter="Action", top_k=2))
    assert [r["major_genre"] for r in given] == ["Action"] * 2
    one = rows(catalog.get_movie_by_title("film 3"))[0]
    assert rows(catalog.get_movie_by_id(one["id"]))[0]["title"] == "Film 3"
    assert rows(catalog.get_movie_by_id("x")) == []
    near = rows(catalog.get_similar_movies(one["id"]))
    assert len(near) == 5 and one["id"] not in {r["id"] for r in near}
    assert rows(catalog.get_similar_movies("x")) == []
    assert [r["major_genre"] for r in catalog.list_genres().collect()] == ["Action", "Drama"]
    assert rows(catalog.get_dataset_stats())[0]["total_movies"] == 16
    for bad in (dict(query=""), dict(query="x", decade=1700), dict(query="x", min_imdb_rating=11.0)):
        with pytest.raises(ValueError):
            catalog.search_movies_by_description(**bad)

    asked = spark.createDataFrame([(1, "drama", 3), (2, "", 3)], "query_id int, query string, top_k int")
    answers, refused = catalog.answer(asked)
    assert {r["query_id"] for r in rows(answers)} == {1} and answers.count() == 3
    assert [r["query_id"] for r in rows(refused)] == [2]
