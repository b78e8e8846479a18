"""Title lookup: exact first, then the best trigram match.

Equal titles are collapsed on both sides before anything is matched, so a title
held by a third of the rows takes part once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions.text import set_similarity, trigrams
from catalith.operators.search import as_results
from catalith.session import scratch_scope, settle

# Similarity levels searched one after the other; a query leaves at the first
# level that finds something, which is then its best match overall.
LEVELS = (0.85, 0.7, 0.5, fixed.TRIGRAM_THRESHOLD)
# Catalog titles of one trigram that are matched in one task.
POSTINGS_PER_TASK = 20_000
# Trigrams that a key is made of, at most, and the work of a key in pairs that meet.
DEEPEST = 3
KEY_COST = 20
# Words of 64 bits that outline a set, so that pairs can be refused where they meet.
OUTLINE_WORDS = 2

_DETAILS = tuple(c for c in fixed.RESULT_COLUMNS if c not in ("similarity", "match_type"))


def _preference() -> Column:
    """Which row stands for a title that several rows share: earliest, then id."""
    year = F.col("release_year")
    return F.struct(year.isNull(), year, F.col("id"))


def _one_per(df: DataFrame, key: str) -> DataFrame:
    """The preferred row of each key, by partial aggregation."""
    details = F.struct(*[F.col(c) for c in _DETAILS])
    return df.groupBy(key).agg(F.min_by(details, _preference()).alias("row"))


def title_exact(corpus: DataFrame, title: str) -> DataFrame:
    """One row whose title is equal but for case."""
    found = (
        corpus.where(F.lower("title") == F.lower(F.lit(title)))
        .orderBy(_preference())
        .limit(1)
    )
    return as_results(found, F.lit(1.0), "exact")


def title_fuzzy(
    corpus: DataFrame, title: str, threshold: float = fixed.TRIGRAM_THRESHOLD
) -> DataFrame:
    """The row with the most similar title, if it reaches the threshold."""
    score = set_similarity(trigrams(F.col("title")), trigrams(F.lit(title)))
    found = (
        corpus.where(F.col("title").isNotNull())
        .withColumn("_score", score)
        .where(F.col("_score") >= threshold)
        .orderBy(F.col("_score").desc(), _preference())
        .limit(1)
    )
    return as_results(found, F.col("_score"), "fuzzy")


def title_lookup(corpus: DataFrame, title: str) -> DataFrame:
    """Exact, and fuzzy only when that finds nothing."""
    exact = title_exact(corpus, title)
    hits = exact.select(F.count(F.lit(1)).alias("n")).scalar()
    return exact.unionByName(title_fuzzy(corpus.where(hits == 0), title))


def _with_grams(df: DataFrame, title: str, out: str) -> DataFrame:
    """Adds the trigram set as a sorted array; rows without one are left out."""
    return df.withColumn(out, F.sort_array(trigrams(F.col(title)))).where(F.size(out) > 0)


def _numbered(sets: DataFrame, name: str) -> DataFrame:
    """Stored with a number per row, which is cheaper to join on than a set."""
    return settle(sets.withColumn(name, F.monotonically_increasing_id()), name)


def _gram_codes(sets: DataFrame, key: str) -> DataFrame:
    """``gram, code``: numbers for the trigrams in use, the rarest lowest."""
    counts = (
        sets.select(F.explode(key).alias("gram"))
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    ranked = counts.orderBy("times", "gram").withColumn("code", F.monotonically_increasing_id())
    return ranked.select("gram", "code")


def _coded(sets: DataFrame, number: str, key: str, codes: DataFrame) -> DataFrame:
    """Each set by its number, as ``size`` and its known trigrams ``codes``, rarest first.

    Trigrams the catalog does not hold count in the size only. ``bits0``, ``bits1``, ... are
    the outline: every known trigram sets the bit of its code.
    """
    spot = F.pmod("code", F.lit(64 * OUTLINE_WORDS))
    bit = F.expr("shiftleft(1L, cast(code % 64 AS int))")
    outline = [
        F.coalesce(F.bit_or(F.when(F.floor(spot / 64) == n, bit)), F.lit(0).cast("long")).alias(name)
        for n, name in enumerate(_outline())
    ]
    return (
        sets.select(number, F.size(key).alias("size"), F.explode(key).alias("gram"))
        .join(codes, "gram", "left")
        .groupBy(number, "size")
        .agg(F.sort_array(F.collect_list("code")).alias("codes"), *outline)
    )


def _outline() -> list[str]:
    return [f"bits{n}" for n in range(OUTLINE_WORDS)]


def _missing(one: str, other: str) -> Column:
    """Trigrams of set ``one`` that ``other`` lacks, at least: bits of its outline the other has not set."""
    lacks = [
        F.bit_count(F.col(f"{one}.{bits}").bitwiseAND(F.bitwise_not(F.col(f"{other}.{bits}"))))
        for bits in _outline()
    ]
    return sum(lacks[1:], lacks[0])


def _class_of(size: Column) -> Column:
    """Sizes in classes, four to a doubling."""
    return F.floor(F.log2(size) * 4 + 1e-9).cast("int")


def _least_in(kind: Column) -> Column:
    return F.ceil(F.pow(F.lit(2.0), kind / 4) - 1e-6).cast("int")


def _needed(size: Column, level: float) -> Column:
    """Trigrams that a set of similarity ``level`` shares with one of ``size``, at least."""
    return F.ceil(size * level - 1e-9).cast("int")


def _asked_prefixes(asked: DataFrame, level: float, kinds: Sequence[int]) -> DataFrame:
    """A row per asked set, class of held sizes it can match, and trigram of its prefix.

    Two sets that share ``n`` trigrams share one of the first ``size - n + 1`` of each, in
    any one order of all trigrams; rarest first makes those few. (Prefix filter of Bayardo
    et al., "Scaling Up All Pairs Similarity Search", WWW 2007.) Unknown trigrams are the
    rarest, and come before the known ones; as they are never shared, they bound the size
    of a match, too.
    """
    size, known = F.col("size"), F.size("codes")
    least = _needed(size, level)
    most = F.floor(F.least(size / level, known * ((1 + level) / level) - size) + 1e-9).cast("int")
    reach = F.filter(
        F.sequence(_class_of(least), _class_of(most)),
        lambda kind: kind.isin(*kinds) if kinds else F.lit(False),
    )
    met = F.greatest(least, _least_in(F.col("kind")))
    shared = F.ceil((size + met) * (level / (1 + level)) - 1e-9).cast("int")
    return _prefixes(
        asked.where(most >= least).withColumn("kind", F.explode(reach)), known - shared + 1
    )


def _held_prefixes(held: DataFrame, level: float) -> DataFrame:
    size = F.col("size")
    return _prefixes(held.withColumn("kind", _class_of(size)), size - _needed(size, level) + 1)


def _prefixes(sets: DataFrame, length: Column) -> DataFrame:
    """A row per trigram ``code`` of the prefix, at ``at``; ``length`` is the prefix's."""
    return (
        sets.withColumn("length", length)
        .where(F.col("length") > 0)
        .select(
            "*",
            F.posexplode(F.slice("codes", F.lit(1), F.col("length"))).alias("at", "code"),
        )
    )


def _depths(asked: DataFrame, held: DataFrame, level: float) -> DataFrame:
    """``code, kind, depth, parts``: how many trigrams two sets must share to meet.

    Where ``code`` is the first trigram two sets share, the next ones they share follow in
    prefixes that are longer by as many. A frequent trigram is therefore matched together with
    one or two that follow it: more keys, but far fewer sets that meet. Both sides look up
    the depth with the least work, so that does not grow with the square of the table. Trigrams
    that one side lacks are left out.
    """
    counted = [
        side.groupBy("code", "kind").agg(F.count(F.lit(1)).cast("double").alias(name))
        for side, name in ((asked, "a"), (held, "h"))
    ]
    rows, pairs = F.col("a") + F.col("h"), F.col("a") * F.col("h")
    least = _least_in(F.col("kind"))
    follow = least - _needed(least, level) + 1
    work = [
        pairs,
        rows * follow * KEY_COST + pairs / 16,
        rows * follow * (follow + 1) / 2 * KEY_COST + pairs / 256,
    ]
    best = F.array_position(F.array(*work), F.least(*work)).cast("int")
    depth = F.least(best, F.greatest(F.lit(1), _needed(least, level)))
    parts = F.when(F.col("depth") == 1, F.ceil(F.col("h") / POSTINGS_PER_TASK)).otherwise(1)
    return (
        counted[0]
        .join(counted[1], ["code", "kind"])
        .withColumn("depth", depth)
        .select("code", "kind", "depth", parts.cast("int").alias("parts"))
    )


def _keys(prefixes: DataFrame, depths: DataFrame, number: str) -> DataFrame:
    """``key`` of each group of trigrams by which a set is met; ``left`` is how many it shares at most."""
    found = prefixes.join(depths, ["code", "kind"]).withColumn("_last", F.col("at"))
    picked = [F.col("code")]
    for deeper in range(1, DEEPEST):
        # Positions count from 0; the trigram after the prefix is the first that may follow.
        end = F.least(F.col("length") + deeper, F.size("codes")) - 1
        follow = F.when(F.col("_last") < end, F.sequence(F.col("_last") + 1, end))
        follow = F.when(F.col("depth") > deeper, follow).otherwise(F.array(F.col("_last")))
        found = found.withColumn("_last", F.explode(follow))
        pick = F.when(F.col("depth") > deeper, F.get("codes", F.col("_last")))
        found = found.withColumn(f"_pick{deeper}", pick)
        picked.append(F.col(f"_pick{deeper}"))
    return found.select(
        number,
        "size",
        "parts",
        F.size("codes").alias("known"),
        *_outline(),
        (F.size("codes") - F.col("_last") - 1 + F.col("depth")).alias("left"),
        F.xxhash64("kind", *picked).alias("key"),
    )


def _met(wanted: DataFrame, offered: DataFrame, level: float) -> DataFrame:
    """``asked_no, held_no``: pairs of sets that share a key and may reach ``level``, once each."""
    wanted, offered = wanted.alias("a"), offered.alias("h")
    asked_size, held_size = F.col("a.size"), F.col("h.size")
    comparable = (held_size >= asked_size * level - 1e-9) & (asked_size >= held_size * level - 1e-9)
    # At the first trigrams two sets share, what follows bounds what they share in
    # all. A pair that passes nowhere else passes there.
    needed = (asked_size + held_size) * (level / (1 + level)) - 1e-9
    enough = F.least(F.col("a.left"), F.col("h.left")) >= needed
    # So does what either is seen to lack, by their outlines. (Bitmap filter of Sandes et al.,
    # "Bitmap filter: speeding up exact set similarity joins", Information Systems 2020.)
    alike = F.least(
        F.col("a.known") - _missing("a", "h"), F.col("h.known") - _missing("h", "a")
    ) >= needed
    return (
        wanted.join(
            offered,
            (F.col("a.key") == F.col("h.key"))
            & (F.col("a.part") == F.col("h.part"))
            & comparable
            & enough
            & alike,
        )
        .select("asked_no", "held_no")
        .distinct()
    )


def _best_sets(asked: DataFrame, held: DataFrame, level: float) -> DataFrame:
    """``asked_no, held_no, similarity``: the best held set of each asked one.

    Keys are small rows with the outline of their set. Most sets that share one differ too
    much, which the outlines show where they meet, so few pairs are written down. Only
    then are their trigrams fetched and compared. The catalog side of a frequent trigram is
    spread over several tasks, with the asked side repeated for each.
    """
    kinds = [row["kind"] for row in held.select(_class_of(F.col("size")).alias("kind")).distinct().collect()]
    wanted, offered = _asked_prefixes(asked, level, kinds), _held_prefixes(held, level)
    depths = settle(_depths(wanted, offered, level), "depths")
    wanted = (
        _keys(wanted, depths, "asked_no")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts")
    )
    offered = (
        _keys(offered, depths, "held_no")
        .withColumn("part", F.pmod(F.xxhash64("held_no"), F.col("parts")).cast("int"))
        .drop("parts")
    )
    # Written down, few pairs are known to be few, and the held sets they are joined with are not shuffled.
    met = settle(_met(wanted, offered, level), "met")
    asked_size, held_size = F.col("a.size"), F.col("h.size")
    shared = F.size(F.array_intersect("a.codes", "h.codes"))
    best_first = F.struct(-F.col("similarity"), F.col("first"))
    return (
        met.join(held.alias("h"), "held_no")
        .join(asked.alias("a"), "asked_no")
        .select(
            "asked_no",
            "held_no",
            "first",
            (asked_size + held_size).alias("_sizes"),
            shared.alias("_shared"),
        )
        .withColumn("similarity", F.col("_shared") / (F.col("_sizes") - F.col("_shared")))
        .where(F.col("similarity") >= level)
        .groupBy("asked_no")
        .agg(F.min_by(F.struct("held_no", "similarity"), best_first).alias("_best"))
        .select("asked_no", "_best.*")
    )


def title_match(
    corpus: DataFrame, queries: DataFrame, levels: Sequence[float] = LEVELS
) -> DataFrame:
    """Best match for a table ``query_id, title``: exact, else fuzzy, else no row.

    The result is stored; what is put down on the way is removed.
    """
    with scratch_scope(corpus.sparkSession, "title-match") as scope:
        return scope.keep(_title_match(corpus, queries, levels), "matches")


def _title_match(corpus: DataFrame, queries: DataFrame, levels: Sequence[float]) -> DataFrame:
    asked = queries.where(F.col("title").isNotNull()).select(
        "query_id", F.lower("title").alias("wanted")
    )
    wanted = asked.select("wanted").distinct()
    named = corpus.where(F.col("title").isNotNull()).withColumn("wanted", F.lower("title"))
    held = settle(_one_per(named, "wanted"), "titles")
    exact = wanted.join(held, "wanted").select(
        "wanted", "row", F.lit(1.0).alias("similarity"), F.lit("exact").alias("_type")
    )

    # Titles with the same trigrams are one candidate, their preferred row its row.
    missed = settle(
        _with_grams(wanted.join(held, "wanted", "left_anti"), "wanted", "asked_set"), "missed"
    )
    sets = _with_grams(held.select("wanted", "row.*"), "wanted", "held_set")
    sets = _numbered(
        _one_per(sets, "held_set").withColumn(
            "first",
            F.struct(
                F.col("row.release_year").isNull().alias("undated"),
                F.col("row.release_year").alias("release_year"),
                F.col("row.id").alias("id"),
            ),
        ),
        "held_no",
    )
    codes = settle(_gram_codes(sets, "held_set"), "gram-codes")
    offered = _coded(sets, "held_no", "held_set", codes)
    offered = settle(offered.join(sets.select("held_no", "first"), "held_no"), "offered")
    asked_sets = _numbered(missed.select("asked_set").distinct(), "asked_no")
    open_sets = settle(_coded(asked_sets, "asked_no", "asked_set", codes), "asked")
    matches = None
    for level in sorted(levels, reverse=True):
        best = settle(_best_sets(open_sets, offered, level), "best")
        open_sets = open_sets.join(best, "asked_no", "left_anti")
        matches = best if matches is None else matches.unionByName(best)
    fuzzy = (
        missed.join(asked_sets, "asked_set")
        .join(matches, "asked_no")
        .join(sets.select("held_no", "row"), "held_no")
        .select("wanted", "row", "similarity", F.lit("fuzzy").alias("_type"))
    )
    matched = asked.join(exact.unionByName(fuzzy), "wanted").select(
        "query_id", "row.*", "similarity", "_type"
    )
    return as_results(matched, F.col("similarity"), F.col("_type"), extra=("query_id",))
