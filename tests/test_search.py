from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith import fixed
from catalith.operators import nearest, search, stats, validate
from checks.model import hashing_model
from tests.conftest import rows

SCHEMA = (
    "id string, title string, release_year int, decade int, major_genre string, "
    "mpaa_rating string, director string, distributor string, imdb_rating double, "
    "rt_rating bigint, imdb_rating_imputed boolean, embedding array<float>"
)


def uid(n):
    return f"00000000-0000-0000-0000-{n:012d}"


@pytest.fixture(scope="module")
def corpus(spark):
    def item(n, title, year, genre, label, rating, vector, guessed=False):
        decade = year // 10 * 10 if year else None
        return (uid(n), title, year, decade, genre, label, "D", "S", rating, 80, guessed, vector)

    return spark.createDataFrame(
        [
            item(1, "East", 1994, "Action", "R", 8.0, [1.0, 0.0]),
            item(2, "North East", 1999, "Action", "PG", 6.0, [1.0, 0.5]),
            item(3, "North", 1994, "Drama", "R", 9.0, [0.0, 1.0]),
            item(4, None, 1994, "Drama", "R", 7.5, [-1.0, 0.0], True),
            item(5, "No vector", 1994, "Action", "R", 9.0, None),
            item(6, "Nowhere", None, None, None, None, [0.0, 0.0]),
        ],
        SCHEMA,
    )


def test_ranking_by_direction(corpus):
    got = rows(search.hybrid_search(corpus, [1.0, 0.0]))
    assert [r["id"] for r in got] == [uid(n) for n in (1, 2, 3, 4, 6)]
    assert [round(r["similarity"], 3) for r in got[:4]] == [1.0, 0.894, 0.0, -1.0]
    assert got[4]["similarity"] is None
    assert got[3]["title"] == ""
    assert {r["match_type"] for r in got} == {"semantic"}


def test_result_columns(corpus):
    found = search.hybrid_search(corpus, [1.0, 0.0])
    assert tuple(found.columns) == fixed.RESULT_COLUMNS
    types = dict(found.dtypes)
    assert types["imdb_rating"] == "double" and types["rt_rating"] == "int"


def test_filters_come_before_the_ranking(corpus):
    def ids(**filters):
        found = search.hybrid_search(corpus, [1.0, 0.0], search.Filters(**filters), top_k=2)
        return [r["id"] for r in rows(found)]

    assert ids() == [uid(1), uid(2)]
    assert ids(genre_filter="Drama") == [uid(3), uid(4)]
    assert ids(genre_filter="drama") == []
    assert ids(decade=1990, min_imdb_rating=7.0) == [uid(1), uid(3)]
    assert ids(mpaa_rating="PG") == [uid(2)]
    assert ids(genre_filter="Drama", min_imdb_rating=7.0, observed_only=True) == [uid(3)]


def test_top_k_is_clamped(corpus):
    assert len(rows(search.hybrid_search(corpus, [1.0, 0.0], top_k=0))) == 1
    assert len(rows(search.hybrid_search(corpus, [1.0, 0.0], top_k=1000, most=3))) == 3
    assert search.clamp_top_k(1000) == 50


def test_single_search_is_one_bounded_sort(corpus):
    found = search.hybrid_search(corpus, search.vector_of(corpus, uid(1)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "Join" not in plan and "Exchange" not in plan


def test_similar_items(corpus):
    got = rows(search.similar_items(corpus, uid(1), top_k=2))
    assert [r["id"] for r in got] == [uid(2), uid(3)]
    assert rows(search.similar_items(corpus, uid(5))) == []
    assert rows(search.similar_items(corpus, uid(99))) == []


def test_lookup_by_id(corpus):
    got = rows(search.lookup_by_id(corpus, "{" + uid(3).upper() + "}"))
    assert [(r["id"], r["similarity"], r["match_type"]) for r in got] == [(uid(3), None, "lookup")]
    assert rows(search.lookup_by_id(corpus, "not-an-id")) == []


def test_lookup_many(spark, corpus):
    asked = spark.createDataFrame(
        [(1, uid(2)), (2, uid(2)), (3, "nonsense"), (4, uid(77))], "request_id int, movie_id string"
    )
    got = rows(search.lookup_many(corpus, asked), "request_id")
    assert [(r["request_id"], r["id"]) for r in got] == [(1, uid(2)), (2, uid(2))]


QUERIES = (
    "query_id int, embedding array<float>, genre_filter string, decade int, "
    "min_imdb_rating double, mpaa_rating string, top_k int"
)


@pytest.mark.parametrize("block", [2_000, 1])
def test_many_queries_equal_single_ones(spark, corpus, block):
    asked = [
        (1, [1.0, 0.0], None, None, None, None, 10),
        (2, [0.0, 1.0], "Action", None, None, None, 1),
        (3, [1.0, 1.0], None, 1990, 7.0, "R", -4),
        (4, [1.0, 1.0], "Nothing", None, None, None, 5),
    ]
    queries = spark.createDataFrame(asked, QUERIES)
    got = rows(search.search_many(corpus, queries, 3, block), "query_id", "rank")
    for query_id, vector, genre, decade, rating, label, top_k in asked:
        filters = search.Filters(genre, decade, rating, label)
        single = rows(search.hybrid_search(corpus, vector, filters, top_k, most=3))
        mine = [r for r in got if r["query_id"] == query_id]
        assert [r["id"] for r in mine] == [r["id"] for r in single]
        assert [r["rank"] for r in mine] == list(range(1, len(single) + 1))


def brute_force(ids, vectors, k):
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    scores = np.round(vectors @ vectors.T / np.outer(norms, norms), 12)
    for i, ident in enumerate(ids):
        order = [j for j in np.lexsort((ids, -scores[i])) if j != i][:k]
        yield from ((ident, at + 1, ids[j]) for at, j in enumerate(order))


@pytest.mark.parametrize("block", [2048, 25])
def test_neighbours_of_all_with_a_third_of_the_rows_equal(spark, block):
    dice = np.random.default_rng(5)
    vectors = dice.normal(size=(120, 6)).astype(np.float32)
    vectors[40:100] = vectors[3]
    vectors[100:110] = vectors[5:15]
    ids = list(range(1, 121))
    data = [(i, v.tolist()) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame([*data, (901, None)], "id int, embedding array<float>")
    got = sorted(
        (r["id"], r["rank"], r["neighbour_id"])
        for r in nearest.similar_many(df, df, 4, block).collect()
    )
    assert got == sorted(brute_force(np.array(ids), vectors.astype(float), 4))


def test_similar_items_of_a_table_equal_single_ones(spark, corpus):
    wanted = spark.createDataFrame([(uid(i),) for i in range(1, 9)] + [(uid(2),), (None,)], "id string")
    got = rows(nearest.similar_many(corpus, wanted, 3), "id", "rank")
    for i in range(1, 9):
        single = rows(search.similar_items(corpus, uid(i), 3))
        mine = [r for r in got if r["id"] == uid(i)]
        assert [r["neighbour_id"] for r in mine] == [r["id"] for r in single]
        assert [r["similarity"] for r in mine] == [r["similarity"] for r in single]


def test_a_vector_without_direction_ranks_last(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(data, "id int, embedding array<float>")
    got = rows(nearest.similar_many(df, df, 5), "id", "rank")
    assert [(r["id"], r["neighbour_id"], r["similarity"]) for r in got] == [
        (1, 3, -1.0), (1, 2, None), (2, 1, None), (2, 3, None), (3, 1, -1.0), (3, 2, None)
    ]


def test_repeated_query_ids_are_refused(spark, corpus):
    asked = [(1, [1.0, 0.0], None, None, None, None, 1), (1, [0.0, 1.0], None, None, None, None, 1)]
    with pytest.raises(ValueError, match="repeated"):
        search.search_many(corpus, spark.createDataFrame(asked, QUERIES))


def test_a_missing_top_k_is_the_default(spark, corpus):
    asked = [(1, [1.0, 0.0], None, None, None, None, None)]
    data = [(f"{i:08d}", [1.0, float(i)]) for i in range(30)]
    many = spark.createDataFrame(data, "id string, embedding array<float>")
    for column, kind in corpus.dtypes:
        if column not in many.columns:
            many = many.withColumn(column, F.lit(None).cast(kind))
    found = search.search_many(many, spark.createDataFrame(asked, QUERIES))
    assert found.count() == 10
    assert search.clamp_top_k(None, default=5) == 5


def test_vectors_of_the_corpus_are_not_shuffled(spark, corpus):
    asked = [(1, [1.0, 0.0], "Drama", None, None, None, 5)]
    queries = spark.createDataFrame(asked, QUERIES).drop("top_k")
    scored = nearest.rank_many(queries, corpus, 5)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    below = plan[: plan.index("MapInArrow")]
    assert "embedding" not in below and "explode" not in plan.lower()
    assert plan.count("MapInArrow") == 1 and plan.rindex("Exchange") < plan.index("MapInArrow")


def test_mixed_vector_lengths_fail(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, embedding array<float>")
    with pytest.raises(Exception, match="different lengths"):
        nearest.vectors_of(df.toArrow())


SENTENCES = [
    ("action movies from the 90s with high IMDB ratings", "Action", 1990, 7.5, None),
    ("critically acclaimed drama films with small budgets", "Drama", None, 7.5, None),
    ("animated family movies distributed by Disney", None, None, None, None),
    ("sci-fi films directed by James Cameron", None, None, None, None),
    (
        "dark psychological thrillers with low Rotten Tomatoes scores",
        "Thriller/Suspense",
        None,
        None,
        None,
    ),
    ("PG-13 comedies from the 1980s", "Comedy", 1980, None, "PG-13"),
    ("a romantic comedy of the nineties", "Romantic Comedy", 1990, None, None),
    ("85s or 05s", None, 1985, None, None),
    ("05s", None, 2005, None, None),
    ("reactions and dramatic westernised things", None, None, None, None),
    ("R rated, unrated", None, None, None, "Not Rated"),
    ("the 2010s or the 80s", None, 2010, None, None),
]


def test_filters_from_sentences(spark):
    df = spark.createDataFrame(
        [(i, s[0]) for i, s in enumerate(SENTENCES)], "query_id int, query string"
    )
    got = rows(search.extract_filters(df), "query_id")
    for row, (_, genre, decade, rating, label) in zip(got, SENTENCES):
        assert (row["genre_filter"], row["decade"], row["min_imdb_rating"], row["mpaa_rating"]) == (
            genre,
            decade,
            rating,
            label,
        )


def test_given_filters_win_and_null_falls_back(spark):
    df = spark.createDataFrame(
        [(1, "action of the 90s", "Drama", None), (2, "action of the 90s", None, 1950)],
        "query_id int, query string, genre_filter string, decade int",
    )
    got = rows(search.extract_filters(df), "query_id")
    assert [(r["genre_filter"], r["decade"]) for r in got] == [("Drama", 1990), ("Action", 1950)]


def test_sentence_search_end_to_end(spark, corpus):
    from catalith.operators.embed import embed_documents

    texts = corpus.where("title is not null").drop("embedding")
    stored = embed_documents(
        texts.withColumn("augmented_text", F.concat(F.lit("Title: "), "title")),
        factory=hashing_model(32),
        dim=32,
    )
    asked = spark.createDataFrame([(1, "drama of the 90s: North")], "query_id int, query string")
    got = rows(search.search_sentences(stored, asked, hashing_model(32), 32))
    assert [r["id"] for r in got] == [uid(3)]
    audit = rows(stats.filter_violations(spark.createDataFrame(got), search.Filters("Drama", 1990)))
    assert audit == [{"rows": 1, "violations": 0}]


def test_bad_requests_are_split_off(spark):
    df = spark.createDataFrame(
        [
            (1, "ok", 999, 5.0, 1990),
            (2, "", 5, None, None),
            (3, None, 5, None, None),
            (4, "x", 5, 10.5, None),
            (5, "x", 5, 10.0, 1879),
            (6, "x", 5, 0.0, 2100),
        ],
        "query_id int, query string, top_k int, min_imdb_rating double, decade int",
    )
    good, bad = validate.split_requests(df)
    assert [r["query_id"] for r in rows(good, "query_id")] == [1, 6]
    assert [r["reason"] for r in rows(bad, "query_id")] == [
        "query must not be empty",
        "query must not be empty",
        "min_imdb_rating must be between 0 and 10",
        "decade must be between 1880 and 2100",
    ]
    with pytest.raises(ValueError, match="unknown arguments"):
        validate.split_requests(df.withColumn("genre", F.lit("x")))


def test_statistics(spark, corpus):
    assert rows(stats.dataset_stats(corpus)) == [
        {
            "total_movies": 6,
            "genres": 2,
            "year_min": 1994,
            "year_max": 1999,
            "avg_imdb_rating": 7.9,
        }
    ]
    empty = rows(stats.dataset_stats(corpus.where("false")))[0]
    assert empty["total_movies"] == 0 and empty["avg_imdb_rating"] is None
    assert [r["major_genre"] for r in stats.list_facets(corpus).collect()] == ["Action", "Drama"]
    assert rows(stats.facet_audit(corpus))[0]["ok"] is True
    missing = {r["column"]: r["missing"] for r in stats.missingness(corpus).collect()}
    assert missing["title"] == 1 and missing["embedding"] == 1 and missing["id"] == 0
    audit = rows(stats.load_audit(corpus, 2))[0]
    assert (audit["rows"], audit["embedded"], audit["dim"], audit["ok"]) == (6, 5, 2, False)
    assert rows(stats.dimension_counts(corpus)) == [{"dim": 2, "n": 5}]


def test_violations_are_counted(corpus):
    found = search.hybrid_search(corpus, [1.0, 0.0])
    audit = rows(stats.filter_violations(found, search.Filters("Action", 1990, 7.0, "R")))
    assert audit == [{"rows": 5, "violations": 4}]


def test_sentences_of_one_file_are_dealt_out(spark):
    asked = spark.range(0, 2000, 1, 1).selectExpr("id AS query_id", "concat('drama of the 90s ', id) AS query")
    found = search.extract_filters(asked)
    assert found.rdd.getNumPartitions() > 1
    assert found.where("genre_filter = 'Drama' AND decade = 1990").count() == 2000
