from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalith.functions import text as tx
from catalith.functions import values as vl
from catalith.operators import clean, dedup
from catalith.operators.reports import nested_report
from tests.conftest import rows


def frame(spark, records):
    names = list(dict.fromkeys(name for record in records for name in record))
    schema = "row_pos int, " + ", ".join(f"`{name}` string" for name in names)
    data = [(i, *[record.get(name) for name in names]) for i, record in enumerate(records)]
    return spark.createDataFrame(data, schema)


def counted(report):
    return {
        (r["metric"], r["field"]): r["value"]
        for r in report.collect()
        if r["value"] is not None
    }


def test_headers_spaced_or_underscored(spark):
    df = frame(spark, [{"Release Date": "x", "US_Gross": "1", "Rotten Tomatoes Rating": "5"}])
    assert clean.rename_headers(df).columns == ["row_pos", "release_date", "us_gross", "rt_rating"]
    assert clean.applied_names(df)["Rotten Tomatoes Rating"] == "rt_rating"


def test_spaces_sentinels_and_aliases(spark):
    df = frame(
        spark,
        [
            {"title": " The  Long \t Night ", "mpaa_rating": "pg13", "director": "None"},
            {"title": "unKNOWN", "mpaa_rating": " not  rated", "director": "A\x1cB"},
            {"title": "NaN", "mpaa_rating": "Weird", "director": "  20th Century  Fox "},
        ],
    )
    got = rows(clean.standardize_strings(df), "row_pos")
    assert [r["title"] for r in got] == ["The Long Night", None, None]
    assert [r["mpaa_rating"] for r in got] == ["PG-13", "Not Rated", "Weird"]
    assert [r["director"] for r in got] == [None, "A B", "20th Century Fox"]


def test_strip_keeps_inner_space_and_handles_blank(spark):
    df = spark.createDataFrame([("  a  b \n",), ("   ",), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(tx.strip(F.col("t"))).collect()] == ["a  b", "", "", "x"]


def test_dates(spark):
    df = frame(
        spark,
        [
            {"title": "a", "release_date": "Mar 31 1999"},
            {"title": "b", "release_date": "may 7 1999"},
            {"title": "c", "release_date": "  "},
            {"title": "d", "release_date": None},
            {"title": "e", "release_date": "not-a-date"},
            {"title": "f", "release_date": "Dec 21 2037"},
            {"title": "g", "release_date": "Feb 29 2016"},
            {"title": "h", "release_date": "1994-05-06"},
            {"title": "i", "release_date": "Feb 30 1999"},
        ],
    )
    got = rows(clean.parse_release_dates(df), "row_pos")
    assert [r["release_date"] for r in got] == [
        dt.date(1999, 3, 31),
        dt.date(1999, 5, 7),
        None,
        None,
        None,
        dt.date(1937, 12, 21),
        dt.date(1916, 2, 29),
        dt.date(1994, 5, 6),
        None,
    ]
    assert got[5]["release_year"] == 1937
    report = counted(clean.cleaning_report(df))
    assert report["dates_parsed", ""] == 5
    assert report["dates_unparseable", ""] == 2
    assert report["dates_century_corrected", ""] == 2
    examples = rows(clean.century_examples(df))
    assert examples[0] == {
        "title": "f",
        "raw": "Dec 21 2037",
        "from_year": "2037",
        "to_year": "1937",
    }


def test_leap_day_without_counterpart_moves_to_the_28th(spark):
    df = frame(spark, [{"title": "a", "release_date": "Feb 29 2000"}])
    got = rows(clean.parse_release_dates(df, last_year=1999))
    assert got[0]["release_date"] == dt.date(1900, 2, 28)


def test_numbers(spark):
    df = frame(
        spark,
        [
            {"imdb_rating": "15", "rt_rating": "-5", "running_time_min": "12", "us_gross": "0"},
            {"imdb_rating": "10", "rt_rating": "0", "running_time_min": "30", "us_gross": "-3"},
            {"imdb_rating": "5d", "rt_rating": "nan", "running_time_min": " 90 ", "us_gross": "1e6"},
        ],
    )
    got = rows(clean.validate_numerics(df), "row_pos")
    assert [r["imdb_rating"] for r in got] == [None, 10.0, None]
    assert [r["rt_rating"] for r in got] == [None, 0.0, None]
    assert [r["running_time_min"] for r in got] == [None, 30.0, 90.0]
    assert [r["us_gross"] for r in got] == [None, None, 1_000_000.0]
    report = counted(clean.cleaning_report(df))
    assert report["numeric_out_of_range", "imdb_rating"] == 1
    assert report["numeric_out_of_range", "us_gross"] == 1
    assert report["numeric_zero_as_missing", "us_gross"] == 1
    assert report["numeric_coerced", "imdb_rating"] == 1
    assert report["numeric_coerced", "rt_rating"] == 1


def test_numbers_of_any_size(spark):
    cells = ["1e100", "1e-300", "inf", "-Infinity", "1e400", "9" * 400, "7" + "0" * 250, "1e5x", "infx"]
    df = frame(spark, [{"us_gross": c, "imdb_rating": c} for c in cells])
    got = rows(clean.validate_numerics(df), "row_pos")
    assert [r["us_gross"] for r in got] == [1e100, 1e-300, None, None, None, None, 7e250, None, None]
    report = counted(clean.cleaning_report(df))
    assert report["numeric_out_of_range", "us_gross"] == 4
    assert report["numeric_coerced", "us_gross"] == 2
    assert report["numeric_out_of_range", "imdb_rating"] == 6


def test_dates_in_other_layouts(spark):
    cells = {
        "18-Jun-1998": (6, 18), "1998-06-18T00:00:00Z": (6, 18), "19980618": (6, 18), "18.06.1998": (6, 18),
        "June 1998": (6, 1), "1998": (1, 1), "06-18-1998": (6, 18), "Jun-18-1998": (6, 18),
        "1998-06-18 10:00": (6, 18), "6/18/98": (6, 18), "Jun 18 1998": (6, 18),
    }
    df = frame(spark, [{"release_date": c} for c in cells])
    got = rows(clean.parse_release_dates(df, last_year=2100), "row_pos")
    moved = {c: r["release_date"] for c, r in zip(cells, got)}
    assert {c: (d.month, d.day) for c, d in moved.items()} == cells
    assert {d.year % 100 for d in moved.values()} == {98}
    report = counted(clean.cleaning_report(df))
    assert report["dates_by_fallback", ""] == len(cells) - 1
    few = clean.parse_release_dates(df, layouts=("yyyy",))
    assert few.where("release_date IS NOT NULL").count() == 1


def test_typed_numbers_lose_nan(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 7.5)], "row_pos int, imdb_rating double")
    assert [r["imdb_rating"] for r in rows(clean.validate_numerics(df), "row_pos")] == [None, 7.5]


def test_duplicates_keep_the_completest_then_most_voted_then_first(spark):
    day = "Jan 1 1990"
    df = frame(
        spark,
        [
            {"Title": "Heat", "Release Date": day, "Director": None, "IMDB Votes": "900"},
            {"Title": " HEAT ", "Release Date": day, "Director": "M", "IMDB Votes": "5"},
            {"Title": "heat", "Release Date": day, "Director": "N", "IMDB Votes": "7"},
            {"Title": "heat", "Release Date": day, "Director": "O", "IMDB Votes": "7"},
            {"Title": "Heat", "Release Date": "Jan 1 1995", "Director": "P"},
            {"Title": None, "Release Date": day},
            {"Title": None, "Release Date": day},
            {"Title": "Heat", "Release Date": "soon"},
        ],
    )
    assert [r["row_pos"] for r in rows(clean.clean(df), "row_pos")] == [2, 4, 5, 6, 7]
    report = counted(clean.cleaning_report(df))
    assert report["rows_in", ""] == 8
    assert report["duplicates_removed", ""] == 3
    assert report["rows_missing_dedup_key", ""] == 3
    assert report["rows_out", ""] == 5
    dated = clean.parse_release_dates(clean.standardize_strings(clean.rename_headers(df)))
    dropped = rows(dedup.dropped_examples(dated))
    assert [r["title"] for r in dropped] == ["heat", "HEAT", "Heat"]


def test_zero_money_still_counts_as_filled_when_duplicates_are_judged(spark):
    day = "Jan 1 1990"
    df = frame(
        spark,
        [
            {"Title": "a", "Release Date": day, "US Gross": None},
            {"Title": "a", "Release Date": day, "US Gross": "0"},
        ],
    )
    got = rows(clean.clean(df))
    assert [(r["row_pos"], r["us_gross"]) for r in got] == [(1, None)]


def test_changed_counts_include_nulled_cells(spark):
    df = frame(spark, [{"Title": "300", "Director": "none"}, {"Title": " x", "Director": "D"}])
    report = counted(clean.cleaning_report(df))
    assert report["strings_normalized", "director"] == 1
    assert report["sentinels_nulled", "director"] == 1
    assert report["strings_normalized", "title"] == 1
    assert report["titles_stringified", ""] == 1


def test_nested_report_leaves_zeros_out(spark):
    df = frame(spark, [{"Title": " x", "Director": "D"}])
    nested = {r["metric"]: r for r in nested_report(clean.cleaning_report(df)).collect()}
    assert nested["strings_normalized"]["by_field"] == {"title": 1.0}
    assert nested["columns_renamed"]["notes"] == {"Title": "title", "Director": "director"}
    assert nested["rows_in"]["total"] == 1.0


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = frame(spark, [{"Title": "a", "Release Date": "Jan 1 1990"}])
    plan = clean.clean(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_half_even(spark):
    df = spark.createDataFrame([(8.95,), (8.45,), (0.25,), (-0.25,)], "x double")
    assert [r[0] for r in df.select(vl.half_even(F.col("x"), 1)).collect()] == [9.0, 8.4, 0.2, -0.2]


def test_one_text_of_many_copies(spark):
    df = spark.createDataFrame(
        [(1, "Same  text"), (2, "same text "), (3, "other"), (4, None), (5, " ")],
        "doc_id int, text string",
    )
    assert [r["doc_id"] for r in rows(dedup.keep_one_text(df, "text", "doc_id"), "doc_id")] == [
        1,
        3,
        4,
        5,
    ]
