from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from catalith.operators import impute
from catalith.operators.quantiles import group_quantiles
from tests.conftest import rows

SCHEMA = "row_pos int, title string, release_year int, major_genre string, imdb_rating double"


def frame(spark, records, extra=""):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(records)], SCHEMA + extra)


def test_group_median_above_the_floor(spark):
    drama = [("t", 1990, "Drama", 5.0)] * 10 + [("gap", 1990, "Drama", None)]
    other = [("u", 1990, "Action", 9.0)] * 30
    got = rows(impute.impute(frame(spark, drama + other)), "row_pos")
    assert got[10]["imdb_rating"] == 5.0
    assert got[10]["imdb_rating_imputed"] is True
    assert got[0]["imdb_rating_imputed"] is False
    assert got[0]["rt_rating_imputed"] is False


def test_small_group_and_missing_genre_use_the_global_median(spark):
    drama = [("t", 1990, "Drama", 8.0)] * 10
    lonely = [("a", 1990, "Horror", 2.0)] * 3 + [("b", 1990, "Horror", None), ("c", 1990, None, None)]
    df = frame(spark, drama + lonely)
    got = rows(impute.impute(df), "row_pos")
    assert got[13]["imdb_rating"] == 8.0
    assert got[14]["imdb_rating"] == 8.0
    assert got[14]["major_genre"] is None
    report = {
        (r["metric"], r["field"]): r["value"] for r in impute.imputation_report(df).collect()
    }
    assert report["imputed_counts", "imdb_rating"] == 2
    assert report["group_median_fills", "imdb_rating"] == 0
    assert report["global_median_fills", "imdb_rating"] == 2
    assert report["global_medians", "imdb_rating"] == 8.0
    assert report["imputed_counts", "major_genre"] == 0


def test_missing_genres_do_not_form_a_group(spark):
    nameless = [("t", 1990, None, 1.0)] * 20 + [("gap", 1990, None, None)]
    named = [("u", 1990, "Action", 9.0)] * 50
    got = rows(impute.impute(frame(spark, nameless + named)), "row_pos")
    assert got[20]["imdb_rating"] == 9.0


def test_a_column_is_rounded_only_when_it_has_a_gap(spark):
    whole = frame(spark, [("a", 1990, "Drama", 7.25), ("b", 1990, "Drama", 6.0)])
    assert [r["imdb_rating"] for r in rows(impute.impute(whole), "row_pos")] == [7.25, 6.0]
    gap = frame(spark, [("a", 1990, "Drama", 7.25), ("b", 1990, "Drama", None)])
    assert [r["imdb_rating"] for r in rows(impute.impute(gap), "row_pos")] == [7.2, 7.2]


def test_a_column_without_any_value_is_flagged_and_stays_missing(spark):
    df = frame(spark, [("a", 1990, "Drama", None), ("b", 1990, "Drama", None)])
    got = rows(impute.impute(df), "row_pos")
    assert [(r["imdb_rating"], r["imdb_rating_imputed"]) for r in got] == [(None, True)] * 2
    report = {
        (r["metric"], r["field"]): r["value"] for r in impute.imputation_report(df).collect()
    }
    assert report["global_median_fills", "imdb_rating"] == 2
    assert ("global_medians", "imdb_rating") not in report


def test_budget_is_grouped_by_decade(spark):
    extra = ", production_budget double"
    nineties = [("t", 1990 + i % 10, "D", 5.0, 10.0) for i in range(12)]
    later = [("u", 2000 + i % 10, "D", 5.0, 90.0) for i in range(30)]
    gaps = [("v", 1994, "D", 5.0, None), ("w", None, "D", 5.0, None)]
    got = rows(impute.impute(frame(spark, nineties + later + gaps, extra)), "row_pos")
    assert got[42]["production_budget"] == 10
    assert got[43]["production_budget"] == 90
    assert isinstance(got[42]["production_budget"], int)


def test_unknown_word_and_facet(spark):
    df = spark.createDataFrame(
        [(0, None, "R", None, None)],
        "row_pos int, director string, mpaa_rating string, source string, major_genre string",
    )
    got = rows(impute.impute_categorical(df))[0]
    assert (got["director"], got["mpaa_rating"], got["source"]) == ("Unknown", "R", "Unknown")
    assert got["major_genre"] is None


@pytest.mark.parametrize("window_values", [1_000_000, 20, 1])
def test_quantiles_are_exact_however_wide_the_groups(spark, window_values):
    dice = random.Random(3)
    data = [("a", dice.gauss(0, 50)) for _ in range(400)]
    data += [("hot", 7.0)] * 900 + [("hot", 7.0 + dice.random() / 100) for _ in range(100)]
    data += [("one", 4.0), (None, 1.0), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {
        (r["k"], r["p"]): (r["quantile"], r["n"])
        for r in group_quantiles(df, ["k"], "x", [0.0, 0.5, 0.95], window_values).collect()
    }
    for key in ("a", "hot", "one", None):
        values = sorted(x for k, x in data if k == key and x is not None)
        assert got[key, 0.5][0] == pytest.approx(statistics.median(values), rel=1e-12)
        assert got[key, 0.0][0] == values[0]
        assert got[key, 0.5][1] == len(values)
        at = (len(values) - 1) * 0.95
        low = int(at)
        high = min(low + 1, len(values) - 1)
        exact = values[low] + (values[high] - values[low]) * (at - low)
        assert got[key, 0.95][0] == pytest.approx(exact, rel=1e-9)


def test_overall_quantile_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert group_quantiles(df, [], "x", [0.95]).first()["quantile"] == pytest.approx(95.0)
