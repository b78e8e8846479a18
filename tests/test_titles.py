from __future__ import annotations

import random

import pytest

from catalith.functions.text import set_similarity, trigrams
from catalith.operators import titles
from pyspark.sql import functions as F
from tests.conftest import rows

SCHEMA = (
    "id string, title string, release_year int, major_genre string, mpaa_rating string, "
    "director string, distributor string, imdb_rating double, rt_rating bigint"
)


def table(spark, named):
    return spark.createDataFrame(
        [(f"i{n:03d}", t, y, None, None, None, None, None, None) for n, (t, y) in enumerate(named)],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def corpus(spark):
    return table(
        spark,
        [
            ("The Matrix", 1999),
            ("Heat", 1995),
            ("HEAT", 1986),
            ("Heat", None),
            ("Amélie 2", 2001),
            (None, 1990),
            ("?!", 1990),
        ],
    )


def grams(text):
    words, word = [], ""
    for letter in text.lower() + " ":
        if letter.isalnum():
            word += letter
        elif word:
            words.append(word)
            word = ""
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_trigrams(spark):
    df = spark.createDataFrame([("Matrix", "Matrx"), ("The  cat!", "cat the"), ("", "a")], "a string, b string")
    got = df.select(
        trigrams(F.col("a")).alias("a"),
        trigrams(F.col("b")).alias("b"),
        set_similarity(trigrams(F.col("a")), trigrams(F.col("b"))).alias("s"),
    ).collect()
    assert set(got[0]["a"]) == {"  m", " ma", "mat", "atr", "tri", "rix", "ix "}
    assert got[1]["s"] == 1.0
    assert got[2]["a"] == [] and got[2]["s"] == 0.0
    for row, (a, b) in zip(got, (("Matrix", "Matrx"), ("The  cat!", "cat the"), ("", "a"))):
        assert set(row["a"]) == grams(a) and set(row["b"]) == grams(b)
        assert row["s"] == pytest.approx(similarity(a, b))


def test_exact_takes_the_earliest(corpus):
    got = rows(titles.title_exact(corpus, "hEAT"))
    assert [(r["id"], r["similarity"], r["match_type"]) for r in got] == [("i002", 1.0, "exact")]


def test_fuzzy_only_when_exact_finds_nothing(corpus):
    got = rows(titles.title_lookup(corpus, "The Matrx"))
    assert [(r["id"], r["match_type"]) for r in got] == [("i000", "fuzzy")]
    assert [r["match_type"] for r in rows(titles.title_lookup(corpus, "heat"))] == ["exact"]
    assert rows(titles.title_lookup(corpus, "Zzzz Qqqq")) == []


@pytest.mark.parametrize("postings", [20_000, 2])
def test_many_titles_equal_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(titles, "POSTINGS_PER_TASK", postings)
    dice = random.Random(11)
    parts = ["red", "blue", "old", "bolt", "gear", "ring", "night", "train", "the"]
    held = [
        (" ".join(dice.choices(parts, k=dice.randint(1, 4))), dice.choice([1980, 1990, None]))
        for _ in range(60)
    ]
    held += [("the red bolt", 1970)] * 40
    asked = []
    for n in range(80):
        text = list(dice.choice(held)[0])
        for _ in range(dice.randint(0, 4)):
            text[dice.randrange(len(text))] = dice.choice("abcdefgh ")
        asked.append((n, "".join(text).upper()))
    asked += [(100, None), (101, "?"), (102, "qqq www")]
    corpus = table(spark, held)
    queries = spark.createDataFrame(asked, "query_id int, title string")
    got = {r["query_id"]: r for r in titles.title_match(corpus, queries).collect()}

    def first(candidates):
        return min(candidates, key=lambda n: (held[n][1] is None, held[n][1] or 0, n))

    for query_id, title in asked:
        equal = [n for n, (t, _) in enumerate(held) if title and t.lower() == title.lower()]
        scores = [similarity(t, title or "") for t, _ in held]
        best = max(scores)
        if equal:
            expected = (f"i{first(equal):03d}", 1.0, "exact")
        elif title and best >= 0.3:
            near = [n for n, s in enumerate(scores) if s == best]
            expected = (f"i{first(near):03d}", best, "fuzzy")
        else:
            assert query_id not in got
            continue
        row = got[query_id]
        assert (row["id"], row["match_type"]) == (expected[0], expected[2])
        assert row["similarity"] == pytest.approx(expected[1])


def number(dice, digits):
    return "".join(dice.choices("012", k=digits))


def test_many_numbers_meet_by_several_trigrams(spark, monkeypatch):
    # Three digits make few trigrams, so one alone would bring most titles together.
    dice = random.Random(5)
    held = [(f"item {number(dice, 10)} no {number(dice, 6)}", 1990) for _ in range(400)]
    asked = [(n, held[n][0].replace("item", "tem")) for n in range(0, 400, 4)]
    asked += [(1000 + n, f"zz{number(dice, 8)}qq") for n in range(50)]
    pairs, depths = [], titles._depths

    def watched(wanted, offered, level):
        found = depths(wanted, offered, level)
        one = wanted.join(offered, ["code", "kind"]).count()
        sides = [titles._keys(side, found, name) for side, name in ((wanted, "asked_no"), (offered, "held_no"))]
        met = sides[0].join(sides[1], "key").select("asked_no", "held_no").distinct()
        pairs.append((one, met.count()))
        return found

    monkeypatch.setattr(titles, "KEY_COST", 0)
    monkeypatch.setattr(titles, "_depths", watched)
    queries = spark.createDataFrame(asked, "query_id int, title string")
    got = {r["query_id"]: r for r in titles.title_match(table(spark, held), queries).collect()}
    one, several = map(sum, zip(*pairs))
    assert several < one / 4
    for query_id, title in asked:
        scores = [similarity(t, title) for t, _ in held]
        best = max(scores)
        if best >= 0.3:
            assert got[query_id]["id"] == f"i{scores.index(best):03d}"
            assert got[query_id]["similarity"] == pytest.approx(best)
        else:
            assert query_id not in got


@pytest.mark.parametrize("words", [1, 2])
def test_outlines_refuse_most_pairs_that_share_a_key(spark, monkeypatch, words):
    dice = random.Random(8)

    def digits(n):
        return "".join(dice.choices("0123456789", k=n))

    held = [(f"customer {digits(10)} number {digits(8)}", 1990) for _ in range(300)]
    asked = [(n, held[n][0].replace("customer", "ustomer")) for n in range(0, 300, 3)]
    asked += [(1000 + n, f"customer {digits(10)} number {digits(8)}") for n in range(30)]
    asked += [(2000 + n, f"zz{digits(8)}qq") for n in range(30)]
    counts, met = [], titles._met

    def watched(wanted, offered, level):
        pairs = met(wanted, offered, level)
        meet = wanted.join(offered, ["key", "part"]).select("asked_no", "held_no").distinct()
        if level > 0.5:
            counts.append((meet.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(titles, "OUTLINE_WORDS", words)
    monkeypatch.setattr(titles, "_met", watched)
    queries = spark.createDataFrame(asked, "query_id int, title string")
    got = {r["query_id"]: r for r in titles.title_match(table(spark, held), queries).collect()}
    meet, compared = map(sum, zip(*counts))
    assert 100 <= compared < meet / 4
    for query_id, title in asked:
        scores = [similarity(t, title) for t, _ in held]
        best = max(scores)
        if best >= 0.3:
            assert got[query_id]["id"] == f"i{scores.index(best):03d}"
            assert got[query_id]["similarity"] == pytest.approx(best)
        else:
            assert query_id not in got
