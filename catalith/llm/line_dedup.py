"""Lines found in several documents stay only in the first of them; built-in functions only.

A line's key is the line without the white space around it, A-Z in lower case. Keys of at least
``LEAST`` characters that two documents hold lose all their lines but those in the document with the
smallest id. Keys travel as 128-bit hashes with document and position.

Hashes are range-partitioned; within a task their rows are sorted by document and streamed past the
first occurrence, and what comes from a later document is dropped. A hash with over a ``SHARES``-th of
all lines, found by a mergeable sketch, is dealt over slices that follow one another; its first document is
aggregated beforehand (at most ``SHARES`` hashes have that many lines), and each slice starts from it. The
sketch only deals rows out; what is dropped does not hang on it.

The result has no texts but a keep bitmap per document, compressed to runs of kept lines; ``apply_keep``
joins the lines of a text that its bitmap keeps.

Defined cases: a null or empty text is one empty line. Rows with equal ids belong to one document, so they
do not make a line repeated; rows without an id are one document as well, the last. Repeated rows are judged
alike, and each stays. A line repeated within one document alone stays. A document may lose all its lines; its
text is then empty. Lines of any number and length are handled whole, one document's dropped positions in a
row. An empty table gives an empty one. A column that is named like a result gives way to it; others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import others
from catalith.session import settle

#: Shorter keys are left alone.
LEAST = 10
#: A hash with more than this share of all lines is dealt over slices.
SHARES = 1_000
#: Counters of the sketch that finds such hashes; its error is below a quarter of a share.
_COUNTERS = 16_384
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lowered(text: Column) -> Column:
    """A-Z in lower case; a text of ASCII alone takes the short way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``no_id, doc_id, mark, place, h, g`` of each line whose key is long enough."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole).alias("mark"), lines_of(_lowered(whole)).alias("lines")
    )
    each = given.select(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", F.posexplode("lines").alias("place", "line")
    )
    each = each.withColumn("key", F.btrim("line", F.lit(_BLANKS))).where(F.char_length("key") >= LEAST)
    return each.select(
        "no_id", "doc_id", "mark", "place", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")
    )


def _hot(lines: DataFrame) -> DataFrame:
    """``h, slices`` of the hashes with over a share of all lines: fewer rows than shares."""
    found = lines.agg(
        F.count("*").alias("lines"), F.expr(f"approx_top_k(h, {SHARES}, {_COUNTERS})").alias("top")
    ).select("lines", F.explode("top").alias("top"))
    share = F.greatest(F.ceil(F.col("lines") / SHARES), F.lit(1))
    slices = F.ceil(F.col("top.count") / share).cast("int")
    return found.select(F.col("top.item").alias("h"), slices.alias("slices")).where("slices > 1")


def _dropped(lines: DataFrame) -> DataFrame:
    """The rows of ``lines`` that an earlier document has, too."""
    place = F.struct("no_id", "doc_id")
    hot = settle(_hot(lines), "hot")
    heads = lines.join(F.broadcast(hot), "h").groupBy("h", "g").agg(F.min(place).alias("head"))
    # The few hashes of many lines start from their first document, whichever slice it is in.
    of_hot = settle(heads.join(hot, "h"), "heads")
    slice_ = F.pmod(F.xxhash64("doc_id", "mark"), F.coalesce("slices", F.lit(1))).cast("int")
    dealt = lines.join(F.broadcast(of_hot), ["h", "g"], "left").withColumn("slice", slice_).drop("slices")
    ranged = dealt.repartitionByRange("h", "g", "slice")
    stream = Window.partitionBy("h", "g", "slice").orderBy("no_id", "doc_id", "place")
    first = F.first(place).over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = ranged.withColumn("first", F.coalesce("head", first))
    return seen.where(F.col("first") < place).select("doc_id", "mark", "place")


def runs(dropped: Column, n_lines: Column) -> Column:
    """The runs (start, length) of kept lines between ascending dropped positions."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: F.coalesce(F.get(dropped, i + 1) != x + 1, F.lit(True)))
    # A kept run ends where a dropped one starts, and the last at the end of the text.
    to = F.concat(starts, F.array(n_lines))
    since = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    spans = F.zip_with(since, to, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(spans, lambda run: run["length"] > 0)


def apply_keep(text: Column, keep: Column) -> Column:
    """The text of the lines that a keep bitmap keeps."""
    lines = lines_of(text)
    kept = F.transform(keep, lambda run: F.slice(lines, run["start"] + 1, run["length"]))
    return F.array_join(F.flatten(kept), "\n")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``keep``, the runs of lines that stay."""
    lines = settle(_hashed(docs, doc_id, text), "lines")
    drops = _dropped(lines).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("place")).alias("_dropped"))
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_of"), "_dropped")
    # Written down, so that a small table of drops is known to be one.
    drops = settle(drops, "drops")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    made = ("n_lines", "n_dropped", "keep")
    given = docs.select(*others(docs, made), F.xxhash64(whole).alias("_mark"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))
    joined = given.join(drops, same, "left").withColumn("_n", F.size(lines_of(F.col(f"`{text}`"))))
    keep = F.when(F.col("_dropped").isNull(), F.array(F.struct(F.lit(0).alias("start"), F.col("_n").alias("length"))))
    return joined.select(
        *others(docs, made),
        F.col("_n").cast("long").alias("n_lines"),
        F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"),
        keep.otherwise(runs(F.col("_dropped"), F.col("_n"))).alias("keep"),
    )

