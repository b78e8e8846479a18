"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.session import tune

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, return.
GAPS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def others(df: DataFrame, made: Iterable[str]) -> list[Column]:
    """The columns an operator hands through.

    A column of the input that is named like one the operator makes gives way to it.
    """
    taken = {name.lower() for name in made}
    return [F.col(f"`{name}`") for name in df.columns if name.lower() not in taken]


def labelled_texts(
    docs: DataFrame, labelled: DataFrame, most: int, doc_id: str, text: str, label: str
) -> DataFrame:
    """``doc_id``, the label and ``text`` of at most ``most`` labelled documents.

    The sample takes the smallest hashes of the ids. However often an id and a label come in
    either table, they give one row, with the text of the smallest hash; tasks reduce their rows to
    these before any text moves. Null ids and labels are left out.
    """
    sample = (
        labelled.select(F.col("doc_id"), F.col(label))
        .where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", label)
        .limit(most)
    )
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("place"), "text"))
    rows = given.join(F.broadcast(sample), "doc_id").groupBy("doc_id", label).agg(first.alias("first"))
    return rows.select("doc_id", label, F.col("first.text").alias("text"))


def words_of(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda word: word != "")


def total(numbers: Column) -> Column:
    """The sum of an array of whole numbers; 0 for an empty or missing one."""
    added = F.aggregate(numbers, F.lit(0).cast("long"), lambda sum_, x: sum_ + x)
    return F.coalesce(added, F.lit(0).cast("long"))
