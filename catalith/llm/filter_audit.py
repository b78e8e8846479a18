"""How filters overlap: what each removes, alone and after the others, in every order.

Each document gets a bit per failure condition. The conditions on its own text are columns. The
existential one (E: some document with a smaller id has the very same text) is a left-semi
self-join on the text's hash, the exact text and a smaller id; the ids it returns are united with the
failures of the other conditions and folded into one bit combination per document. From there on
only counts per part and combination remain, and they answer all orders at once.

Only texts whose hash comes with two ids at least enter the join. Its right side is one row per text,
with the smallest id, reduced in each task first. Hashes of many rows (at most ``SHARES`` of them can
have more than that share of the table) are dealt over slices by id, and the right side's row is repeated per slice.

Defined cases: a null text is empty; empty texts equal one another. A text without words fails A and not B.
A null ``lang`` belongs to the part ``''``. A null id is neither smaller nor larger than any and has no labels. Repeated
rows (equal id and text) count each and are no reason for E by themselves. A document is good or toxic if
any of its labels says so. Very long texts are handled whole. An empty table gives no rows. Other columns,
also ones named like the results, do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import words_of
from catalith.session import settle

#: A hash with more than this share of all rows is dealt over slices; there are fewer of these than shares.
SHARES = 1_000
#: The letter of the existential condition.
TWIN = "E"


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions on a document's own text, by letter."""
    words = words_of(text)
    n_words = F.size(words)
    caps = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n_words,
        "C": 100 * caps.cast("long") > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(failed: dict[str, Column], letters: str) -> Column:
    bits = [F.when(is_so, F.lit(1 << letters.index(name))).otherwise(0) for name, is_so in failed.items()]
    return sum(bits[1:], bits[0])


def copies(texts: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of ``texts`` (``doc_id, text, hash`` and others) whose text a smaller id has, too.

    ``seen`` holds ``doc_id, hash`` of all rows. The result has no text.
    """
    apart = F.min("doc_id") < F.max("doc_id")
    twins = settle(seen.groupBy("hash").agg(F.count("*").alias("n"), apart.alias("apart")).where("apart"), "twins")
    total = twins.agg(F.sum("n")).first()[0] or 0
    each = max(1, -(-total // SHARES))
    slices = F.ceil(F.col("n") / each).cast("int")
    hot = F.broadcast(twins.where(F.col("n") > each).select("hash", slices.alias("slices")))

    def dealt(df: DataFrame) -> DataFrame:
        """One row per slice of the hash."""
        of = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice")
        return df.join(hot, "hash", "left").select(*df.columns, of)

    own = F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1))).cast("int")
    placed = texts.join(hot, "hash", "left").withColumn("slice", own).drop("slices")
    candidates = placed.join(dealt(twins.select("hash")), ["hash", "slice"], "left_semi")
    firsts = dealt(candidates.groupBy("hash", "text").agg(F.min("doc_id").alias("first")))
    firsts = firsts.select(*(F.col(name).alias(f"_{name}") for name in firsts.columns))
    same = (F.col("hash") == F.col("_hash")) & (F.col("slice") == F.col("_slice"))
    same &= (F.col("text") == F.col("_text")) & (F.col("_first") < F.col("doc_id"))
    return candidates.join(firsts, same, "left_semi").drop("text", "slice", "hash")


def combinations(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """``part, good, toxic, mask, n``: documents by failed conditions; and the letters of the mask's bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    texts = texts.withColumns({"hash": F.xxhash64("text"), "digest": F.unhex(F.sha2("text", 256))})
    failed = conditions(F.col("text"))
    letters = "".join(failed) + TWIN
    facts = settle(texts.select("doc_id", "part", "digest", "hash", _bits(failed, letters).alias("bits")), "facts")
    marked = copies(texts, facts.select("doc_id", "hash"))

    key = ["doc_id", "part", "digest"]
    of_copies = F.lit(1 << letters.index(TWIN)).alias("bits")
    united = facts.select(*key, "bits", F.lit(1).cast("long").alias("n")).unionByName(
        marked.select(*key, of_copies, F.lit(0).cast("long").alias("n"))
    )
    each = united.groupBy(*key).agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))
    # However many rows an id has, few combinations of it are left to meet its labels.
    by_id = each.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    flags = [F.coalesce(F.col(name), F.lit(False)).alias(name) for name in ("good", "toxic")]
    counted = by_id.join(said, "doc_id", "left").select("part", *flags, "mask", "n")
    return counted.groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n")), letters


def _mask(names: Column, letters: str) -> Column:
    """The bits of a string of letters."""
    spelled = F.filter(F.split(names, ""), lambda x: x != "")
    bits = F.create_map(*(F.lit(part) for k, name in enumerate(letters) for part in (name, 1 << k)))
    return F.aggregate(spelled, F.lit(0), lambda sum_, x: sum_ + F.element_at(bits, x))


def report(counted: DataFrame, letters: str, orders: Sequence[str] | None = None) -> DataFrame:
    """One row per part, order and step, from the counts of ``combinations``."""
    given = list(orders) if orders is not None else ["".join(p) for p in permutations(letters)]
    every = 1
    for k in range(2, len(letters) + 1):
        every *= k
    step = F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    applied = counted.select("*", F.explode(F.split(F.lit(",".join(given)), ",")).alias("filter_order")).select("*", step)
    applied = applied.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    applied = applied.withColumn("bit", _mask(F.col("filter"), letters))
    applied = applied.withColumn("before", _mask(F.expr("substring(filter_order, 1, step - 1)"), letters))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    lost = fails & ~gone

    def count(what: Column, times: Column = F.lit(1)) -> Column:
        return F.sum(F.when(what, F.col("n") * times).otherwise(0)).cast("long")

    # A document that fails m conditions is removed by each of them in one m-th of all orders.
    share = F.floor(F.lit(every) / F.greatest(F.bit_count("mask"), F.lit(1)))
    return applied.groupBy("part", "filter_order", "step", "filter").agg(
        count(~gone & ~fails).alias("kept"),
        count(lost).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(lost & F.col("good")).alias("good_lost"),
        count(lost & F.col("toxic")).alias("toxic_lost"),
        count(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of all filters in all orders over ``docs`` (``doc_id, text, lang``)."""
    return report(*combinations(docs, labels))
