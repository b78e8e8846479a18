"""From raw documents to packed token ids, in five stages.

Each stage works on all rows its predecessor kept, written as Parquet and read again:
texts that fail the quality rules go, one document of each group of near copies
stays, documents that hold benchmark passages go, documents are repeated or thinned to
the target weights, and what is left is encoded.

All stages but the last return the columns of ``documents``. Repeated rows are judged
each by the rules; of rows with equal id and text one stays. Rows with a null id
or text are treated like any others; a text without words fails the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.llm import decontam, jaccard, mixing, quality_rules
from catalith.llm.common import read
from catalith.llm.queries import token_digests
from catalith.session import scratch_scope, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies: five words in a row, four fifths of them in common.
NEAR = jaccard.Likeness(size=5, num=80, den=100)


#: Shares of tokens; poor documents are gone before the mixing.
TARGETS = {"good": 0.95, "toxic": 0.05}
#: Good documents get this much of the tokens they have, so that a rate a little off drops none.
HEADROOM = 1.2


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{name}`" for name in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    measured = settle(quality_rules.measure(docs), "measured")
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.judge(measured, good).where("kept").select(*_columns(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies, that with the smallest id stays."""
    linked = jaccard.join(docs, NEAR)
    first = linked.where(
        F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("first_mark"))
    )
    first = first.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_of")).distinct()
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))
    chosen = marked.join(first, same, "left_semi")
    twin = Window.partitionBy("doc_id", "_mark").orderBy("_mark")
    return chosen.withColumn("_twin", F.row_number().over(twin)).where("_twin = 1").select(*_columns(docs))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of an item go."""
    found = decontam.find(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as many times as its fitted rate says."""
    domain = F.when(F.col("toxic") == 1, "toxic").otherwise("good")
    labelled = read(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    mixed = mixing.mix(docs, labelled, TARGETS, headroom=HEADROOM)
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return mixed.select(*_columns(docs), times.alias("_copy")).drop("_copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: written, read back, and described per document."""
    return token_digests(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmarks),
    ("mixing sources to target weights", mix_sources),
    ("token ids", encode),
]

#: SQL can express neither the fitted rates nor the tokenizer; tests use a second version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage needs for itself goes when it is done."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark, "stage") as scope:
            made = stage(spark, docs, sf_dir)
            docs = scope.keep(made, name.replace(" ", "-"))
    return docs
