from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions.text import with_prefix
from catalith.operators import embed
from checks.model import HashingModel, hashing_model
from tests.conftest import rows


def test_prefix_is_there_once(spark):
    df = spark.createDataFrame(
        [("  a film\n",), ("search_document: a film",), (" ",)], "t string"
    )
    got = [r[0] for r in df.select(with_prefix(F.col("t"), fixed.DOCUMENT_PREFIX)).collect()]
    assert got == ["search_document: a film", "search_document: a film", "search_document: "]


def test_batches_are_of_fixed_size_and_in_order():
    sizes = []

    def model(texts):
        sizes.append(len(texts))
        return [[float(t)] * 3 for t in texts]

    got = embed.embed_batches(model, ["0", "1", "2", "3", "4"], 3, 2)
    assert got.tolist() == [[float(i)] * 3 for i in range(5)]
    assert sizes == [2, 2, 1]
    assert embed.embed_batches(model, [], 3, 2).shape == (0, 3)
    assert sizes == [2, 2, 1]


def test_wrong_answers_raise():
    with pytest.raises(ValueError, match="2 texts came back as 1 vectors"):
        embed.embed_batches(lambda texts: [[1.0]], ["a", "b"], 1, 8)
    with pytest.raises(ValueError, match="a vector has 2 numbers, not 3"):
        embed.embed_batches(lambda texts: [[1.0, 2.0] for _ in texts], ["a"], 3, 8)


def test_wrong_answers_fail_the_job(spark):
    df = spark.createDataFrame([(1, "a")], "id int, augmented_text string")
    with pytest.raises(Exception, match="a vector has 2 numbers, not 3"):
        embed.embed_documents(df, factory=lambda: lambda texts: [[1.0, 2.0]], dim=3).collect()


def test_each_text_gets_its_own_vector(spark):
    df = spark.createDataFrame(
        [(i, None if i == 7 else f"word{i} " * i) for i in range(20)],
        "id int, augmented_text string",
    ).repartition(3)
    got = rows(embed.embed_documents(df, factory=hashing_model(16), dim=16), "id")
    model = HashingModel(16)
    for row in got:
        if row["id"] == 7:
            assert row["embedding"] is None
        else:
            text = fixed.DOCUMENT_PREFIX + ((f"word{row['id']} " * row["id"]).strip())
            assert row["embedding"] == model([text])[0]


def test_queries_have_their_own_prefix(spark):
    seen = spark.createDataFrame([(1, "x")], "query_id int, query string")
    got = rows(embed.embed_queries(seen, factory=hashing_model(8), dim=8))
    assert got[0]["embedding"] == HashingModel(8)(["search_query: x"])[0]
