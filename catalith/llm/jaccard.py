"""N-gram Jaccard join by a token-group matrix, exact, for sets of word shingles.

1. Every text becomes a set of shingles. Equal sets are one class from here on.
2. Groups of similar classes: classes that share a minimal hash are compared with one
   leader of that hash, and linked where they really are similar enough. The connected
   classes are a group, so a group of near copies costs a comparison per member, not
   one per pair.
3. Tokens are ordered by rarity and only the prefix of each class is posted: so many of
   its rarest tokens that a partner must share one. The matrix keeps, per token and
   group, the union's entry: the smallest and largest set and the best position.
4. A class is compared with the matrix. A group qualifies when length and position leave
   enough room for the overlap; only the members of qualifying groups that hold the
   token are opened, bounded one by one, bounded again by the counts of their tokens in 64
   ranges, and verified on the whole sets.
5. Connected components over all links.

Nothing is missed: the groups of step 2 only save work, since links between groups are
found by steps 3 and 4, whose bounds never exclude a link. The order by rarity comes
from a table of fixed size; tokens that share a cell share a rank, which changes the
work, not the result. Sets are compared as 64-bit hashes of shingles.

All joins are on ids or tokens, so large groups and frequent tokens are split by the
shuffle's skew handling; no step gathers a group. Texts are never shuffled: a bit table
of fixed size picks those whose sets are needed.

Defined cases: a null text or one without words has an empty set and no link. Repeated rows are
equal sets, each with its own row. Of equal links nothing depends on order. A null id is
never a component's id unless all its rows have null ids. Only the id is handed through;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.components import components
from catalith.llm.shingles import shingle_sets
from catalith.session import Scratch, settle

#: Cells of the rarity table, and of the bit table that picks texts.
RARITY_BITS = 21
PICK_BITS = 24
_SLICES = 16
#: Rows of a batch whose sets a task holds at once.
ROWS = 1000
_RANGES = 64
_KEYS = 4
_U = np.uint64


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``size`` words; linked when ``den * intersection >= num * union``."""

    size: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        """So many of the rarest tokens include one that any partner shares."""
        return n + (-self.num * n) // self.den + 1

    def lengths_fit(self, a: Column, b: Column) -> Column:
        return (a * self.den >= b * self.num) & (b * self.den >= a * self.num)

    def room(self, a: Column, b: Column, left: Column) -> Column:
        """Whether ``left`` common tokens would be enough for sets of these sizes."""
        return left * (self.num + self.den) >= (a + b) * self.num


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _fingerprints(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = (found * _U(0x9FB21C651E98DF25) ^ (found >> _U(32))).sum(dtype=_U)
        b = ((found ^ _U(0x2545F4914F6CDD1D)) * (found | _U(1))).sum(dtype=_U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


_PROFILE = (
    "doc_id {id}, mark long, n int, fa long, fb long, keys array<long>,"
    " spread array<int>, cell int, counts binary"
)


def _bits(found: np.ndarray, bits: int) -> np.ndarray:
    return (found >> _U(64 - bits)).astype(np.int64)


def _outline(found: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimal hashes of four parts, and the number of tokens in each of 64 ranges."""
    at = np.searchsorted(found, ranges)
    first = at[:: _RANGES // _KEYS]
    keys = found[first[first < np.append(first[1:], len(found))]]
    return keys.astype(np.int64), np.diff(np.append(at, len(found))).astype(np.int32)


def _profile(size: int, id_type: pa.DataType):
    """A row per text, and at the end of the task its counts of tokens per cell."""
    types = [
        ("doc_id", id_type),
        ("mark", pa.int64()),
        ("n", pa.int32()),
        ("fa", pa.int64()),
        ("fb", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("spread", pa.list_(pa.int32())),
        ("cell", pa.int32()),
        ("counts", pa.binary()),
    ]
    schema = pa.schema(types)
    ranges = np.arange(_RANGES, dtype=_U) << _U(58)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << RARITY_BITS, np.uint32)
        for batch in _parts(batches):
            rows = []
            for found in shingle_sets(_texts(batch), size):
                if not len(found):
                    rows.append((0, None, None, None, None))
                    continue
                np.add.at(seen, _bits(found, RARITY_BITS), 1)
                rows.append((len(found), *_fingerprints(found), *_outline(found, ranges)))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            made = [
                pa.array(list(column), kind)
                for column, (_, kind) in zip(columns, types[2:7], strict=True)
            ]
            blank = [pa.nulls(len(rows), kind) for _, kind in types[7:]]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("mark"), *made, *blank], schema=schema
            )
        if seen.any():
            parts = [zlib.compress(part.tobytes(), 1) for part in np.split(seen, _SLICES)]
            blank = [pa.nulls(_SLICES, kind) for _, kind in types[:7]]
            yield pa.record_batch(
                [*blank, pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())],
                schema=schema,
            )

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the count tables that reach a task, one slice of fixed size per cell."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, packed in zip(*(batch.column(c).to_pylist() for c in ("cell", "counts"))):
            part = np.frombuffer(zlib.decompress(packed), np.uint32)
            # A saturated cell is as frequent as ranks can say.
            total = sums.get(cell, 0) + part.astype(np.uint64)
            sums[cell] = np.minimum(total, _U(2**32 - 1))
    if sums:
        packed = [zlib.compress(v.astype(np.uint32).tobytes(), 1) for v in sums.values()]
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())],
            names=["cell", "counts"],
        )


def _rarity(profile: DataFrame) -> np.ndarray:
    """A rank per cell, the binary logarithm of its count: 2 MB, whatever the corpus."""
    parts = profile.where("cell IS NOT NULL").select("cell", "counts")
    spread = parts.repartition("cell", F.pmod(F.crc32("counts"), F.lit(16)))
    summed = spread.mapInArrow(_add_counts, parts.schema)
    summed = summed.repartition("cell").mapInArrow(_add_counts, parts.schema)
    ranks = np.zeros(1 << RARITY_BITS, np.uint8)
    width = len(ranks) // _SLICES
    for row in summed.collect():
        count = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.uint32)
        ranks[row["cell"] * width : (row["cell"] + 1) * width] = np.log2(count + 1.0)
    return ranks


def _picked(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size in which the fingerprints ``fa`` are set."""
    place = F.shiftrightunsigned("fa", 64 - PICK_BITS)
    words = (
        ids.select(F.floor(place / 32).alias("word"), F.pmod(place, F.lit(32)).cast("int").alias("bit"))
        .select("word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
    )
    table = np.zeros(1 << (PICK_BITS - 5), np.uint32)
    for row in words.toLocalIterator():
        table[row["word"]] = row["mask"]
    return table


def _sets(size: int, like: Likeness, ranks, picks):
    """Per distinct set of a task: its prefix by rarity, and the whole set if it is picked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = picks.value
        rarity = ranks.value if ranks is not None else None
        told: set[tuple[int, int]] = set()
        for batch in _parts(batches):
            rows = []
            for found in shingle_sets(_texts(batch), size):
                if not len(found):
                    continue
                fa, fb = _fingerprints(found)
                if (fa, fb) in told:
                    continue
                told.add((fa, fb))
                place = (fa & 0xFFFFFFFFFFFFFFFF) >> (64 - PICK_BITS)
                whole = found.astype(np.int64) if table[place >> 5] >> (place & 31) & 1 else None
                prefix = None
                if rarity is not None:
                    order = np.argsort(rarity[_bits(found, RARITY_BITS)], kind="stable")
                    prefix = found[order[: like.prefix(len(found))]].astype(np.int64)
                if whole is not None or prefix is not None:
                    rows.append((fa, fb, len(found), prefix, whole))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2]
                yield pa.record_batch(
                    [
                        pa.array(list(column), kind)
                        for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)
                    ],
                    names=["fa", "fb", "n", "prefix", "tokens"],
                )

    return run


_SETS = "fa long, fb long, n int, prefix array<long>, tokens array<long>"


def _verified(pairs: DataFrame, tokens: DataFrame, like: Likeness) -> DataFrame:
    """Pairs ``u, v`` of classes that are similar enough, by their whole sets."""
    one = tokens.select(F.col("id").alias("u"), F.col("tokens").alias("left"))
    two = tokens.select(F.col("id").alias("v"), F.col("tokens").alias("right"))
    both = pairs.join(one, "u").join(two, "v")
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return both.where(common * like.den >= union * like.num).select("u", "v")


def _bounded(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs ``u, v`` whose counts of tokens in each range leave room for the overlap."""
    a = classes.select(F.col("id").alias("u"), F.col("n").alias("a"), F.col("spread").alias("s"))
    b = classes.select(F.col("id").alias("v"), F.col("n").alias("b"), F.col("spread").alias("t"))
    common = F.aggregate(
        F.zip_with("s", "t", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x
    )
    both = pairs.join(a, "u").join(b, "v")
    both = both.where(like.lengths_fit(F.col("a"), F.col("b")))
    return both.where(like.room(F.col("a"), F.col("b"), common)).select("u", "v")


def _leaders(classes: DataFrame) -> DataFrame:
    """Pairs of a class and the leader of one of its minimal hashes: the class with most copies."""
    keyed = classes.select("id", "copies", F.explode("keys").alias("key"))
    best = keyed.groupBy("key").agg(
        F.max(F.struct("copies", (-F.col("id")).alias("id"))).alias("best"), F.count("*").alias("n")
    )
    led = best.where("n > 1").select("key", (-F.col("best.id")).alias("v"))
    pairs = keyed.join(led, "key").where("id <> v")
    return pairs.select(F.col("id").alias("u"), "v").distinct()


def _opened(postings: DataFrame, like: Likeness) -> DataFrame:
    """Pairs ``u, v`` of classes of two groups that the bounds do not rule out."""
    matrix = postings.groupBy("token", F.col("grp").alias("g")).agg(
        F.min("pos").alias("first"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.max("members").alias("size"),
    )
    # The smaller group asks the larger one, so a large one is asked as a whole.
    asks = (F.col("members") < F.col("size")) | (
        (F.col("members") == F.col("size")) & (F.col("grp") < F.col("g"))
    )
    n, num, den = F.col("n"), like.num, like.den
    longest = F.least("most", F.floor(n * den / num))
    shortest = F.greatest("least", F.ceil(n * num / den))
    qualifies = (
        (shortest <= longest)
        & like.room(n, longest, longest - F.col("first"))
        & like.room(n, shortest, n - F.col("pos"))
    )
    asked = postings.join(matrix, "token").where(asks & qualifies)
    asked = asked.select("token", "g", F.col("id").alias("u"), F.col("n").alias("a"), F.col("pos").alias("i"))
    held = postings.select(
        "token", F.col("grp").alias("g"), F.col("id").alias("v"), F.col("n").alias("b"), F.col("pos").alias("j")
    )
    a, b = F.col("a"), F.col("b")
    left = F.least(a - F.col("i"), b - F.col("j"))
    opened = asked.join(held, ["token", "g"]).where(like.lengths_fit(a, b) & like.room(a, b, left))
    return opened.select("u", "v").distinct()


def join(
    docs: DataFrame, like: Likeness = Likeness(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, first_mark`` for every row of ``docs``.

    ``component_id`` is the smallest id a row reaches by links. ``mark`` is a hash of the
    text, which tells rows of one id apart; the row whose id and mark are ``component_id`` and
    ``first_mark`` stands for the component.
    """
    spark = docs.sparkSession
    given = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("mark"),
        F.col(f"`{text}`").alias("text"),
    )
    texts = given.select("text")
    id_type = given.schema["doc_id"].dataType.simpleString()
    arrow_id = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    with Scratch(spark, "jaccard") as scratch:
        profile = scratch.settle(
            given.mapInArrow(_profile(like.size, arrow_id), _PROFILE.format(id=id_type)), "profile"
        )
        ranks = spark.sparkContext.broadcast(_rarity(profile))
        rows = profile.where("cell IS NULL").drop("cell", "counts")
        classes = scratch.settle(
            rows.where("n > 0")
            .groupBy("fa", "fb")
            .agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"),
                F.count("*").alias("copies"),
                F.max("n").alias("n"),
                F.any_value("keys").alias("keys"),
                F.any_value("spread").alias("spread"),
            )
            .withColumn("id", F.monotonically_increasing_id()),
            "classes",
        )
        named = classes.select("id", "fa", "fb")

        def sets_of(pairs: DataFrame, ranked: bool, name: str) -> DataFrame:
            ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
            table = spark.sparkContext.broadcast(_picked(named.join(ids, "id", "left_semi")))
            found = texts.mapInArrow(
                _sets(like.size, like, ranks if ranked else None, table), _SETS
            )
            return scratch.settle(found, name)

        def tokens_of(found: DataFrame, pairs: DataFrame) -> DataFrame:
            ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
            whole = found.where("tokens IS NOT NULL").select("fa", "fb", "tokens")
            whole = whole.join(named.join(ids, "id", "left_semi"), ["fa", "fb"])
            return whole.groupBy("id").agg(F.any_value("tokens").alias("tokens"))

        led = scratch.settle(_bounded(_leaders(classes), classes, like), "leaders")
        found = sets_of(led, True, "prefixes")
        links = scratch.settle(_verified(led, tokens_of(found, led), like), "links")
        grouped = components(links)
        groups = scratch.settle(
            named.join(grouped.withColumnRenamed("node", "id"), "id", "left").select(
                "id", "fa", "fb", F.coalesce("component", "id").alias("grp")
            ),
            "groups",
        )
        sizes = groups.groupBy("grp").agg(F.count("*").alias("members"))
        prefixes = (
            found.select("fa", "fb", "prefix")
            .groupBy("fa", "fb")
            .agg(F.any_value("prefix").alias("prefix"))
            .join(named, ["fa", "fb"])
        )
        posted = scratch.settle(
            prefixes.select("id", F.posexplode("prefix").alias("pos", "token")), "postings"
        )
        scratch.drop(found)
        # A token that one class alone holds joins nothing.
        shared = posted.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        kept = scratch.settle(
            posted.join(shared.where("low <> high").select("token"), "token", "left_semi"), "shared"
        )
        scratch.drop(posted)
        member_of = groups.join(sizes, "grp").join(classes.select("id", "n"), "id")
        postings = scratch.settle(kept.join(member_of.drop("fa", "fb"), "id"), "matrix-rows")
        scratch.drop(kept)
        opened = scratch.settle(_bounded(_opened(postings, like), classes, like), "opened")
        more = _verified(opened, tokens_of(sets_of(opened, False, "sets"), opened), like)
        joined = components(links.union(scratch.settle(more, "more")))
        member = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").select(
            "fa", "fb", "first", F.coalesce("component", "id").alias("component")
        )
        least = member.groupBy("component").agg(F.min("first").alias("least"))
        member = member.join(least, "component").select(
            F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), "least"
        )
        result = rows.join(
            member, (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb")), "left"
        ).select(
            "doc_id",
            "mark",
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
            F.when(F.col("least").isNull(), F.col("mark")).otherwise(F.col("least.mark")).alias("first_mark"),
        )
        return settle(result, "jaccard")
