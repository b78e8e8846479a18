from __future__ import annotations

from catalith.operators import features
from tests.conftest import rows

COLUMNS = (
    "row_pos int, title string, major_genre string, director string, mpaa_rating string, "
    "release_year int, running_time_min bigint, imdb_rating double, imdb_votes bigint, "
    "rt_rating bigint, production_budget bigint, worldwide_gross bigint, distributor string, "
    "creative_type string, source string, running_time_min_imputed boolean, "
    "production_budget_imputed boolean, rt_rating_imputed boolean, imdb_rating_imputed boolean"
)
FULL = dict(
    row_pos=0,
    title="Night Train",
    major_genre="Drama",
    director="A. Person",
    mpaa_rating="PG-13",
    release_year=1994,
    running_time_min=121,
    imdb_rating=7.4,
    imdb_votes=240732,
    rt_rating=83,
    production_budget=55_000_000,
    worldwide_gross=210_000_000,
    distributor="Big House",
    creative_type="Fiction",
    source="Novel",
    running_time_min_imputed=False,
    production_budget_imputed=False,
    rt_rating_imputed=False,
    imdb_rating_imputed=False,
)


def one(spark, **changes):
    record = FULL | changes
    return rows(features.augment(spark.createDataFrame([tuple(record.values())], COLUMNS)))[0]


def test_text_of_a_full_row(spark):
    assert one(spark)["augmented_text"] == (
        "Title: Night Train\n"
        "Genre: Drama\n"
        "Director: A. Person\n"
        "MPAA Rating: PG-13\n"
        "Release Year: 1994\n"
        "Runtime: 121 minutes\n"
        "IMDB Rating: 7.4/10 (240,732 votes)\n"
        "Rotten Tomatoes: 83%\n"
        "Budget: $55,000,000\n"
        "Distributor: Big House\n"
        "Creative Type: Fiction\n"
        "Source: Novel"
    )


def test_text_leaves_out_what_was_not_observed(spark):
    text = one(
        spark,
        director="Unknown",
        major_genre=None,
        running_time_min_imputed=True,
        imdb_votes=None,
        rt_rating_imputed=None,
    )["augmented_text"]
    assert "Director" not in text and "Genre" not in text and "Runtime" not in text
    assert "IMDB Rating: 7.4/10\n" in text and "Rotten Tomatoes: 83%" in text
    assert "IMDB" not in one(spark, imdb_rating_imputed=True)["augmented_text"]


def test_budget_bands_use_observed_budgets(spark):
    bands = [
        one(spark, production_budget=b)["budget_tier"]
        for b in (500_000, 15_000_000, 30_000_000, 75_000_000, 100_000_000, None)
    ]
    assert bands == ["indie", "mid", "mid", "major", "blockbuster", None]
    assert one(spark, production_budget_imputed=True)["budget_tier"] is None


def test_outcome(spark):
    def outcome(gross, budget, **more):
        return one(spark, worldwide_gross=gross, production_budget=budget, **more)[
            "blockbuster_flag"
        ]

    assert outcome(500_000_000, 100_000_000) is True
    assert outcome(200_000_000, 250_000_000) is False
    assert outcome(20_000_000, 1_000_000) is False
    assert outcome(None, 50_000_000) is None
    assert outcome(100_000_000, None) is True
    assert outcome(100_000_000, 900_000_000, production_budget_imputed=True) is True


def test_decade_and_delta(spark):
    got = one(spark, release_year=1999)
    assert got["decade"] == 1990
    assert abs(got["rating_score_delta"] - (-9.0)) < 1e-9
    assert one(spark, rt_rating_imputed=True)["rating_score_delta"] is None


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(0, "Only a title")], "row_pos int, title string")
    got = rows(features.augment(df))[0]
    assert got["augmented_text"] == "Title: Only a title"
    assert got["decade"] is None and got["blockbuster_flag"] is None


def test_report(spark):
    records = [tuple((FULL | {"row_pos": i, "rt_rating": None}).values()) for i in range(2)]
    df = features.augment(spark.createDataFrame(records, COLUMNS))
    report = {
        (r["metric"], r["field"]): r["value"] for r in features.augmentation_report(df).collect()
    }
    assert report["budget_tier_counts", "major"] == 2
    assert report["feature_coverage", "rating_score_delta"] == 0
    assert report["augmented_text_rows", ""] == 2
    assert report["mean_text_lines", ""] == 11
    counts = rows(features.value_counts(df, "budget_tier"))
    assert counts == [{"value": "major", "n": 2}]
