"""Runs that pay for new rows only: vectors and medians."""

from __future__ import annotations

import os
import random

import pytest

from catalith import fixed
from catalith.operators import impute
from catalith.operators.embed import embed_documents
from catalith.operators.vector_store import VectorStore
from catalith.session import scratch_path
from catalith.sources.states import CountStates
from tests.conftest import rows

DIM = 4


def counting_model(asked):
    """A model whose vectors tell the text, and which counts what it is asked."""

    def factory():
        def model(texts):
            asked.add(len(texts))
            return [[float(len(t)), float(sum(map(ord, t)) % 1000), *[0.5] * (DIM - 2)] for t in texts]

        return model

    return factory


TEXTS = "id long, text string, embedding string"


def test_second_run_asks_for_new_texts_only(spark, shared):
    asked = spark.sparkContext.accumulator(0)
    factory = counting_model(asked)
    store = VectorStore(spark, scratch_path(spark, "vectors"), "counting-1")
    first = [(i, f"text {i % 40}", "old") for i in range(100)] + [(200, None, "old"), (201, "", "old")]
    df = spark.createDataFrame(first, TEXTS)
    options = {"factory": factory, "dim": DIM, "batch": 8}
    got = rows(store.embed(df, "text", **options), "id")
    assert asked.value == 41  # each text once, and the empty one
    plain = rows(embed_documents(df, "text", **options), "id")
    assert got == [{k: row[k] for k in got[0]} for row in plain]
    before = asked.value
    again = rows(store.embed(df, "text", **options), "id")
    assert again == got and asked.value == before
    more = spark.createDataFrame([*first, (300, "text 3", "x"), (301, "new", "x"), (302, "new", "x")], TEXTS)
    found = rows(store.embed(more, "text", **options), "id")
    assert asked.value == before + 1 and store.read().count() == 42
    assert found[: len(got)] == got and found[-1]["embedding"] == found[-2]["embedding"]


def test_other_models_and_prefixes_share_nothing(spark, shared):
    asked = spark.sparkContext.accumulator(0)
    options = {"factory": counting_model(asked), "dim": DIM}
    path = scratch_path(spark, "vectors")
    df = spark.createDataFrame([(1, "a", "")], TEXTS)
    for model, prefix in (("m", "p: "), ("m", "q: "), ("mp", ": "), ("m", "p: ")):
        VectorStore(spark, path, model).embed(df, "text", prefix=prefix, **options).collect()
    assert asked.value == 3
    assert VectorStore(spark, path, "m").embed(df.where("id > 1"), "text", **options).count() == 0


def test_a_failed_run_stores_nothing(spark, shared):
    def broken():
        return lambda texts: [[1.0]] * len(texts)  # of the wrong length

    store = VectorStore(spark, scratch_path(spark, "vectors"), "broken")
    df = spark.createDataFrame([(1, "a", "")], TEXTS)
    with pytest.raises(Exception, match="not"):
        store.embed(df, "text", factory=broken, dim=DIM)
    assert store.read().count() == 0


def test_a_text_stored_twice_gives_one_vector(spark, shared):
    asked = spark.sparkContext.accumulator(0)
    options = {"factory": counting_model(asked), "dim": DIM}
    store = VectorStore(spark, scratch_path(spark, "vectors"), "m")
    df = spark.createDataFrame([(1, "a", ""), (2, "a", "")], TEXTS)
    store.embed(df, "text", **options)
    store.read().write.mode("append").parquet(store.path)  # what another run at the same time does
    assert store.embed(df, "text", **options).count() == 2


ITEMS = "release_year int, major_genre string, imdb_rating double, rt_rating double, running_time_min double"


def part(seed, n):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice([None, *values])
    return [
        (rng.randrange(1960, 2020), pick("Drama", "Comedy"), pick(*range(1, 10)), pick(40, 55.5, 90), pick(80, 100, 121))
        for _ in range(n)
    ]


def medians_after(states):
    return rows(impute.medians_of_counts(states.read()), "column", "scope", "key")


def test_medians_of_three_loads_equal_a_full_recompute(spark, shared):
    states = CountStates(spark, scratch_path(spark, "states"), [*impute.MEDIAN_KEYS, "value"])
    parts = [spark.createDataFrame([(a, b, *map(lambda x: None if x is None else float(x), c)) for a, b, *c in part(k, 60)], ITEMS) for k in range(3)]
    for number, df in enumerate(parts):
        states.add(number, impute.observed_values(df))
    whole = parts[0].union(parts[1]).union(parts[2])
    wanted = rows(impute.medians(whole), "column", "scope", "key")
    assert medians_after(states) == wanted and len(wanted) >= 10
    states.add(2, impute.observed_values(parts[2]))  # offered again
    assert medians_after(states) == wanted
    assert states.compact() == 2 and states.loads() == (2, [])
    states.add(2, impute.observed_values(parts[2]))  # again, after it was summed up
    assert medians_after(states) == wanted
    # The fourth load replaces all rows of the first.
    states.add(3, impute.observed_values(parts[1]), removed=impute.observed_values(parts[0]))
    wanted = rows(impute.medians(parts[1].union(parts[1]).union(parts[2])), "column", "scope", "key")
    assert medians_after(states) == wanted
    filled = impute.impute_numeric(parts[0], impute.medians_of_counts(states.read()))
    assert filled.where("rt_rating IS NULL").count() == 0 and set(fixed.MEDIAN_GROUPS) > {"rt_rating"}


def test_an_unfinished_load_does_not_count(spark, shared):
    states = CountStates(spark, scratch_path(spark, "states"), ["k"])
    with pytest.raises(ValueError, match="no load"):
        states.read()
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    states.add(0, df)
    df.groupBy("k").count().write.parquet(f"{states.path}/loads/1")
    folder = f"{states.path}/loads/1/_SUCCESS".removeprefix("file:")
    os.remove(folder)  # the writer did not finish
    assert rows(states.read(), "k") == [{"k": "a", "n": 2}, {"k": "b", "n": 1}]
    states.add(4, df.limit(0), removed=df)
    assert rows(states.read()) == []
