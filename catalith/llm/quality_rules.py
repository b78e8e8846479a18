"""Quality rules with thresholds learned per language and source.

A text is measured with built-in functions only. Each measure is a whole number, and
its distribution in a group is a quantile sketch: counts per bucket, where a bucket
spans at most a sixteenth of its value. Sketches merge by adding counts, so a task
sums its own rows before anything moves, a group of any size is a few hundred counts,
and the result does not depend on how the rows were dealt.

A group's sketch is completed by its language's and that of all texts, which together weigh as much as
``PRIOR`` rows: the fewer rows a group has, the more they say, without a step at any size. The
rank of a value is the share of that sketch on its near side. How far out a rank
may lie is learned for each measure: as far as documents known to be good lie in their own groups, but for
``LOSE`` in 10,000 of them. No measure has a cutoff of its own; each can reject, and the same rank is another
value in every group. Ties are judged alike, as they share a bucket.

Without documents known to be good, only the base rule rejects.

Defined cases: a null or blank text has no words and fails the base rule. A null
language or source is a group of its own. Repeated rows count and are judged one by
one. An empty table gives an empty result. An input column named like a made one is
replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import others, total, words_of
from catalith.session import settle

SYMBOLS = r"[#*$%&|<>]"
#: Rows that a language's sketch and that of all texts weigh in a group's, half each.
PRIOR = 200
#: Good documents, per 10,000, that one measure may reject.
LOSE = 5
#: Measures: per 10,000 but for the mean word length, which is in hundredths.
MEASURES = ("symbol_rate", "caps_rate", "dup_line_rate", "repeat_rate", "word_length")
#: Measures that may also be too low.
TWO_SIDED = ("word_length",)
_MADE = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    *MEASURES,
)


def _rate(part: Column, whole: Column, scale: int) -> Column:
    return F.when(whole > 0, F.floor(part * scale / whole)).otherwise(0).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the base counts, the base verdict and the measures.

    Windows of five words are compared as 64-bit hashes. Only a text in which one
    comes twice has its windows sorted, so a text of n words costs n log n at most.
    """
    kept = others(docs, _MADE)
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = docs.select(
        *kept,
        words_of(raw).alias("_qr_words"),
        F.filter(
            F.split(raw, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")
        ).alias("_qr_lines"),
        F.regexp_count(raw, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(raw, F.lit("[A-Z]")).cast("long").alias("_qr_caps"),
    )
    step = step.select(
        *kept,
        "n_symbols",
        "_qr_caps",
        F.size("_qr_words").cast("long").alias("n_words"),
        total(F.transform("_qr_words", F.char_length)).alias("word_chars"),
        F.size("_qr_lines").cast("long").alias("_qr_n_lines"),
        (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines")))
        .cast("long")
        .alias("n_dup_lines"),
        F.transform("_qr_words", lambda word: F.xxhash64(word)).alias("_qr_hash"),
    )

    def carry(*names: str) -> list:
        counts = ("n_symbols", "_qr_caps", "n_words", "word_chars", "_qr_n_lines", "n_dup_lines")
        return [*kept, *counts, *names]

    def pair(left: str, right: str, offset: int) -> Column:
        shifted = F.slice(right, offset + 1, F.greatest(F.size(right), F.lit(1)))
        return F.zip_with(left, shifted, lambda a, b: F.xxhash64(a, b))

    step = step.select(*carry("_qr_hash"), pair("_qr_hash", "_qr_hash", 1).alias("_qr_two"))
    step = step.select(*carry("_qr_hash"), pair("_qr_two", "_qr_two", 2).alias("_qr_four"))
    windows = F.slice(
        pair("_qr_four", "_qr_hash", 4), F.lit(1), F.greatest(F.size("_qr_hash") - 4, F.lit(0))
    )
    step = step.select(*carry(), windows.alias("_qr_five"))
    twice = F.size(F.array_distinct("_qr_five")) < F.size("_qr_five")
    ranked = F.array_sort(
        F.transform("_qr_five", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    step = step.select(*carry(), F.when(twice, ranked).alias("_qr_ranked"))
    follows = F.zip_with(
        "_qr_ranked",
        F.slice("_qr_ranked", 2, F.size("_qr_ranked")),
        lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)),
    )
    step = step.select(*carry("_qr_ranked"), follows.alias("_qr_follows"))
    either = F.zip_with(
        "_qr_follows",
        F.concat(F.array(F.lit(False)), "_qr_follows"),
        lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
    )
    places = F.zip_with("_qr_ranked", either, lambda x, hit: F.when(hit, x["i"]))
    step = step.select(*carry(), F.array_sort(F.array_compact(places)).alias("_qr_places"))
    spans = F.zip_with(
        "_qr_places",
        F.slice("_qr_places", 2, F.greatest(F.size("_qr_places"), F.lit(1))),
        lambda here, there: F.least(F.lit(5), F.coalesce(there - here, F.lit(5))),
    )
    step = step.select(*carry(), total(spans).alias("n_repeat_words"))
    failed = (F.col("n_words") < 10) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * 20
    )
    return step.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        _rate(F.col("n_symbols"), F.col("n_words"), 10_000).alias("symbol_rate"),
        _rate(F.col("_qr_caps"), F.col("word_chars"), 10_000).alias("caps_rate"),
        _rate(F.col("n_dup_lines"), F.col("_qr_n_lines"), 10_000).alias("dup_line_rate"),
        _rate(F.col("n_repeat_words"), F.col("n_words"), 10_000).alias("repeat_rate"),
        _rate(F.col("word_chars"), F.col("n_words"), 100).alias("word_length"),
    )


def bucket(value: Column) -> Column:
    """The sketch's bucket: values below 32 have their own, others share 16 per power of two."""
    spare = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return (spare * 16 + F.call_function("shiftright", value, spare)).cast("long")


def bucket_top(number: Column) -> Column:
    """The largest value that falls into a bucket."""
    spare = F.greatest(F.floor(number / 16) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", number - spare * 16 + 1, spare) - 1


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """Counts per group, measure and bucket, of the texts that pass the base rule."""
    values = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("measure"), bucket(F.col(name)).alias("bucket"))
                for name in MEASURES
            )
        )
    )
    rows = measured.where(~F.col("base_failed")).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("value")
    )
    return rows.groupBy("lang", "source", "value.measure", "value.bucket").agg(
        F.count("*").alias("n")
    )


def _ranked(own: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, below, above`` of each group, at each bucket that any group has.

    ``below`` and ``above`` are the shares, per million, of the group's completed sketch on either side.
    """
    level = ["measure", "bucket"]
    by_lang = own.groupBy("lang", *level).agg(F.sum("n").alias("n_lang"))
    by_all = own.groupBy(*level).agg(F.sum("n").alias("n_all"))
    grid = own.select("lang", "source", "measure").distinct().join(by_all, "measure")

    def beside(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
        """``n`` of the right side where its group and bucket are the left's, else 0."""
        named = right.select(*(F.col(c).alias(f"_{c}") for c in right.columns))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        both = left.join(named, reduce(lambda a, b: a & b, same), "left")
        return both.select(*left.columns, F.coalesce(f"_{n}", F.lit(0)).alias(n))

    grid = beside(grid, by_lang, ["lang", *level], "n_lang")
    grid = beside(grid, own, ["lang", "source", *level], "n")
    group = Window.partitionBy("lang", "source", "measure")
    order = group.orderBy("bucket")
    sides = {
        "below": order.rowsBetween(Window.unboundedPreceding, -1),
        "above": order.rowsBetween(1, Window.unboundedFollowing),
    }

    def part(name: str, side) -> Column:
        return F.coalesce(F.sum(name).over(side), F.lit(0)).cast("double")

    def whole(name: str) -> Column:
        return F.sum(name).over(group).cast("double")

    # Sums first: a share is one division of whole numbers, the same in any engine.
    sums = {f"{k}_{name}": part(name, side) for k, side in sides.items() for name in ("n", "n_lang", "n_all")}
    grid = grid.withColumns(sums | {f"in_{name}": whole(name) for name in ("n", "n_lang", "n_all")})

    def rank(k: str) -> Column:
        prior = F.col(f"{k}_n_lang") / F.col("in_n_lang") + F.col(f"{k}_n_all") / F.col("in_n_all")
        share = (F.col(f"{k}_n") + prior * (PRIOR / 2)) / (F.col("in_n") + PRIOR)
        return F.floor(share * 1_000_000).cast("long")

    return grid.select("lang", "source", *level, *(rank(k).alias(k) for k in sides))


def _farthest(good: DataFrame, ranked: DataFrame) -> DataFrame:
    """``measure, side, farthest``: the rank up to which documents are kept."""
    named = good.select(*(F.col(c).alias(f"_{c}") for c in good.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("lang", "source", "measure", "bucket")]
    placed = ranked.join(named, reduce(lambda a, b: a & b, same))
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(k).alias("rank")) for k in ("below", "above"))))
    counted = placed.select("measure", "_n", sides.alias("at")).groupBy("measure", "at.side", "at.rank")
    each = Window.partitionBy("measure", "side")
    beyond = each.orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    lost = counted.agg(F.sum("_n").alias("n")).select(
        "measure",
        "side",
        "rank",
        F.coalesce(F.sum("n").over(beyond), F.lit(0)).alias("lost"),
        F.sum("n").over(each).alias("of"),
    )
    return lost.where(F.col("lost") * 10_000 <= F.col("of") * LOSE).groupBy("measure", "side").agg(
        F.min("rank").alias("farthest")
    )


def thresholds(
    measured: DataFrame, good: DataFrame | None = None, lang: str = "lang", source: str = "source"
) -> DataFrame:
    """One row of fences per language and source; a fence is null where none was learned."""
    own = settle(sketches(measured, lang, source), "sketches")
    ranked = settle(_ranked(own), "ranked")
    if good is None:
        farthest = measured.sparkSession.createDataFrame([], "measure string, side string, farthest long")
    else:
        known = good.select(F.col("doc_id").alias("_good")).distinct()
        of_good = measured.join(known, F.col("doc_id") == F.col("_good"), "left_semi")
        farthest = settle(_farthest(sketches(of_good, lang, source), ranked), "farthest")
    inside = {
        "most": (F.max, F.col("side") == "below", F.col("below") <= F.col("farthest")),
        "least": (F.min, F.col("side") == "above", F.col("above") <= F.col("farthest")),
    }
    joined = ranked.join(farthest, "measure", "left")

    def fence(name: str, end: str) -> Column:
        pick, side, near = inside[end]
        place = pick(F.when((F.col("measure") == name) & side & near, F.col("bucket")))
        # A bucket's least value is one more than the largest of the bucket before.
        return bucket_top(place) if end == "most" else F.when(place > 0, bucket_top(place - 1) + 1)

    return joined.groupBy("lang", "source").agg(
        *(fence(name, "most").alias(f"most_{name}") for name in MEASURES),
        *(fence(name, "least").alias(f"least_{name}") for name in TWO_SIDED),
    )


def judge(
    measured: DataFrame,
    good: DataFrame | None = None,
    lang: str = "lang",
    source: str = "source",
    verdict: str = "kept",
) -> DataFrame:
    """Measured rows with the verdict: the base rule, then the fences of their group.

    ``good`` has the ``doc_id`` of documents known to be good. ``measured`` is read several times;
    store it first. The thresholds are joined, not collected; the optimizer broadcasts
    them while they are small.
    """
    fences = thresholds(measured, good, lang, source)
    fences = fences.select(*(F.col(c).alias(f"_qr_{c}") for c in fences.columns))
    joined = measured.join(
        fences,
        F.col(lang).eqNullSafe(F.col("_qr_lang")) & F.col(source).eqNullSafe(F.col("_qr_source")),
        "left",
    )
    inside = [F.col(name) <= F.col(f"_qr_most_{name}") for name in MEASURES]
    inside += [F.col(name) >= F.col(f"_qr_least_{name}") for name in TWO_SIDED]
    fits = reduce(lambda a, b: a & b, [F.coalesce(x, F.lit(True)) for x in inside])
    return joined.select(
        *others(measured, [verdict]),
        (~F.col("base_failed") & fits).alias(verdict),
    )
