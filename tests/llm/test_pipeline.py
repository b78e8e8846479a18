"""The pipeline: each stage against a second version, on its own input."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from catalith.llm import quality_rules
from checks.compare import compare, connect
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """The input of every stage and the result, as the stages hand them on."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, out[-1], small).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(steps):
    assert [df.columns for df in steps[:-1]] == [COLUMNS] * 5


def test_quality_stage(spark, steps, small):
    kept = {r["doc_id"] for r in steps[1].collect()}
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1")
    judged = quality_rules.judge(quality_rules.measure(steps[0]), good).collect()
    assert kept == {r["doc_id"] for r in judged if r["kept"]}
    for row in steps[0].collect():
        n, _, _, _, repeated = brute.quality(row["text"])
        if n < 10 or 100 * repeated > 20 * n:
            assert row["doc_id"] not in kept


def test_near_copies_stage(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    wanted = set(brute.components(rows, 5, 80, 100).values())
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted(wanted)


def test_decontamination_stage(spark, steps, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in steps[2].collect() if not brute.contamination(r["text"], items)[1]]
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(clean)


def test_mixing_stage_repeats_documents_whole(steps):
    before = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    after = steps[4].collect()
    assert all(before[r["doc_id"]] == r["text"] for r in after)
    assert len({r["doc_id"] for r in after}) > 0.8 * len(before)


def test_encoding_stage(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {
        r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        for r in steps[4].collect()
    }
    rows = sorted(steps[5].collect(), key=lambda r: r["start"])
    assert len(rows) == steps[4].count()
    starts = np.cumsum([0] + [lengths[r["doc_id"]] for r in rows])
    assert [r["start"] for r in rows] == starts[:-1].tolist()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_run_is_the_stages_and_leaves_nothing_else(spark, small, steps, shared):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, small).collect())
    assert got == sorted(tuple(r) for r in steps[-1].collect())
    left = shared()
    assert len(left) == 5 and all(name.endswith("-kept") for name in left)


def test_stages_on_nulls_and_empty_tables(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(None, None, None, None, None), (None, long, None, None, None), (1, long, "en", "s", 1), (1, long, "en", "s", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
        made = docs.collect()
        assert {r["doc_id"] for r in made} == ({1} if given else set())


def test_queries_match_their_sql(spark, small):
    import __spark_entry__ as entry

    connection, sql = connect(small), entry.oracle_sql()
    for name in [n for n in entry.queries() if n.startswith("op") and n in sql]:
        assert compare(spark, connection, entry.queries()[name], sql[name], small)[0] == "", name
