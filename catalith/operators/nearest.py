"""Nearest rows by cosine similarity, exact, for tables of queries and of rows.

Up to ``QUERY_BLOCK`` queries go to all tasks, and rows stay where they lie: a task streams its rows
past the queries, scores only those that pass a query's filters, and sends on its best ``k`` per
query. More queries are dealt into blocks that group equal filters, rows into parts, and
Spark brings each block together with each part in a task of its own; none of them passes the
driver. The best of all tasks are found in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith import fixed
from catalith.session import settle

#: Queries that go to the tasks at once, and those of a block beyond that.
QUERY_BLOCK = 4096
#: Rows that meet a block in one task: at most so many on average, and no fewer than are worth a task.
PART_ROWS = 50_000
LEAST_ROWS = 2_000
#: Parts in which a query's finds are ranked before all of them are.
PARTS = 16
# Scores below every cosine: a row without a direction ranks last, one that a
# filter excludes does not rank.
_NO_DIRECTION = -2.0
_EXCLUDED = -np.inf
_SCORE_DIGITS = 12
_SLICE_CELLS = 1 << 22

Match = tuple[np.ndarray, np.ndarray, np.ndarray]


def matrix_of(lists: pa.Array) -> np.ndarray:
    """An Arrow list column as a float64 matrix; mixed lengths raise."""
    lengths = pc.unique(pc.list_value_length(lists))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.to_pylist()}")
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def vectors_of(table: pa.Table, column: str = "embedding") -> np.ndarray:
    return matrix_of(table.column(column).combine_chunks())


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Query by row: cosine similarity, or the mark of a row without a direction.

    Products of equal vectors may differ in the last bits with their place in the
    matrix. Ties must not, hence the rounding.
    """
    scale = _norms(queries)[:, None] * _norms(rows)[None, :]
    scores = np.full(scale.shape, _NO_DIRECTION)
    np.divide(queries @ rows.T, scale, out=scores, where=scale > 0)
    return scores.round(_SCORE_DIGITS)


def similarity_to(embedding: Column, vector: Sequence[float]) -> Column:
    """Cosine similarity of a column to one given vector, scored batch by batch.

    NULL for a row without a vector or without a direction.
    """
    query = np.array([list(vector)], dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def score(lists: pa.Array) -> pa.Array:
        given = pc.is_valid(lists).to_numpy(zero_copy_only=False)
        answer = np.full(len(lists), _NO_DIRECTION)
        if given.any():
            rows = matrix_of(lists.drop_null())
            if rows.shape[1] != query.shape[1]:
                raise ValueError(f"vectors of length {rows.shape[1]}, not {query.shape[1]}")
            answer[given] = cosines(query, rows)[0]
        return pa.array(answer, mask=answer == _NO_DIRECTION)

    return score(embedding)


def _best_per_query(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> Match:
    """The first ``k`` of every query, by score and then id."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    place = np.arange(len(at))
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = at[1:] != at[:-1]
    keep = place - np.maximum.accumulate(np.where(opens, place, 0)) < k
    return at[keep], ids[keep], scores[keep]


def best_matches(
    queries: np.ndarray,
    ids: pa.ChunkedArray,
    rows: np.ndarray,
    k: int,
    allowed: np.ndarray | None = None,
    best: Match | None = None,
) -> Match:
    """Best ``k`` rows of each query, merged with what was found before."""
    names = np.asarray(ids.to_pylist())
    step = max(1, _SLICE_CELLS // max(1, len(queries)))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        scores = cosines(queries, rows[part])
        if allowed is not None:
            scores[~allowed[:, part]] = _EXCLUDED
        least = np.full(len(queries), _EXCLUDED)
        if scores.shape[1] > k:
            cut = scores.shape[1] - k
            least = np.partition(scores, cut, axis=1)[:, cut]
        at, found = np.nonzero((scores >= least[:, None]) & (scores > _EXCLUDED))
        hit = (at, names[part][found], scores[at, found])
        if best is not None:
            hit = tuple(np.concatenate(pair) for pair in zip(best, hit))
        best = _best_per_query(*hit, k)
    return best


def match_table(best: Match, query_ids: pa.Array, id_type: pa.DataType) -> pa.Table:
    """``query_id, id, similarity``; no similarity for a row without a direction."""
    at, ids, scores = best
    return pa.table(
        {
            "query_id": query_ids.take(pa.array(at)),
            "id": pa.array(ids.tolist(), type=id_type),
            "similarity": pa.array(scores, mask=scores == _NO_DIRECTION),
        }
    )


def match_schema(queries: DataFrame, rows: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


#: Columns of a query that a row must equal, and the row's column.
EQUAL = {"genre_filter": "major_genre", "decade": "decade", "mpaa_rating": "mpaa_rating"}
_FLOOR = ("min_imdb_rating", "imdb_rating")


class _Group:
    """Queries of a block with the same equality filters."""

    def __init__(self, places: np.ndarray, wanted: dict[str, object]) -> None:
        self.places, self.wanted = places, wanted

    def rows(self, codes: dict[str, tuple[np.ndarray, dict]], size: int) -> np.ndarray:
        """Rows of a batch that pass the filters."""
        keep = np.ones(size, bool)
        for column, value in self.wanted.items():
            have, known = codes[column]
            keep &= have == known.get(value, -2)
        return np.flatnonzero(keep)


def _groups(asked: pa.Table) -> list[_Group]:
    names = [n for n in EQUAL if n in asked.column_names]
    if not names:
        return [_Group(np.arange(asked.num_rows), {})]
    found: dict[tuple, list[int]] = {}
    for place, values in enumerate(zip(*(asked.column(n).to_pylist() for n in names))):
        found.setdefault(values, []).append(place)
    return [
        _Group(np.array(places), {EQUAL[n]: v for n, v in zip(names, values) if v is not None})
        for values, places in found.items()
    ]


def _best_of(asked: pa.Table, batches: Iterator[pa.RecordBatch], k: int) -> pa.Table | None:
    """Best ``k`` of the rows per query asked; None if there are no rows."""
    vectors = vectors_of(asked)
    groups = _groups(asked)
    wanted, has = _FLOOR
    floors = None
    if wanted in asked.column_names:
        floors = np.array([np.nan if v is None else v for v in asked.column(wanted).to_pylist()])
    best: Match | None = None
    id_type = None
    for batch in batches:
        if not batch.num_rows:
            continue
        id_type = batch.schema.field("id").type
        codes = {}
        for column in {c for g in groups for c in g.wanted}:
            coded = pc.dictionary_encode(batch.column(column))
            known = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
            codes[column] = (coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), known)
        ratings = None
        if floors is not None and not np.isnan(floors).all():
            given = batch.column(has).cast(pa.float64())
            ratings = given.to_numpy(zero_copy_only=False)
        rows = matrix_of(batch.column("embedding"))
        hits = [] if best is None else [best]
        for group in groups:
            at = group.rows(codes, batch.num_rows)
            if not len(at):
                continue
            allowed = None
            if ratings is not None:
                floor = floors[group.places]
                allowed = np.isnan(floor)[:, None] | (ratings[at][None, :] >= floor[:, None])
            ids = pa.chunked_array([batch.column("id").take(pa.array(at))])
            place, found, scores = best_matches(vectors[group.places], ids, rows[at], k, allowed)
            hits.append((group.places[place], found, scores))
        if hits:
            joined = tuple(np.concatenate(part) for part in zip(*hits))
            best = _best_per_query(*joined, k)
    if best is None:
        return None
    return match_table(best, asked.column("query_id").combine_chunks(), id_type)


def _score(block, k: int):
    """Best ``k`` rows of a task per query of the one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _best_of(block.value, batches, k)
        if found is not None:
            yield from found.to_batches()

    return run


def _score_part(k: int):
    """Best ``k`` rows of a part per query of a block."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = _best_of(asked, rows.to_batches(), k) if asked.num_rows else None
        if found is not None:
            return found
        none = (asked.schema.field("query_id").type, rows.schema.field("id").type, pa.float64())
        return pa.table([pa.array([], t) for t in none], names=["query_id", "id", "similarity"])

    return run


def _in_a_grid(queries: DataFrame, rows: DataFrame, k: int, blocks: int, schema: T.StructType) -> DataFrame:
    """Every block of queries beside every part of the rows."""
    n_rows = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n_rows // PART_ROWS), min(-(-2 * cores // blocks), -(-n_rows // LEAST_ROWS)), 1)
    filters = [n for n in EQUAL if n in queries.columns]
    stored = settle(
        queries.repartitionByRange(blocks, *filters, "query_id").withColumn("_block", F.spark_partition_id()),
        "queries",
    )
    # Ids are distinct, so ranges over filters and id are of about one size.
    asked = stored.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumns(
        {
            "_part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"),
            "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
        }
    )
    key = ["_block", "_part"]
    return asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_score_part(k), schema)


def rank_many(queries: DataFrame, rows: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, id, similarity`` of the best ``k`` rows of every query.

    ``queries`` has ``query_id``, ``embedding`` and any of the filters; ``rows`` has ``id``,
    ``embedding`` and the columns these compare with. Both should be stored.
    """
    spark = rows.sparkSession
    sizes = queries.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("ids")).first()
    if sizes["ids"] != sizes["n"]:
        raise ValueError("query ids are repeated")
    schema = match_schema(queries, rows)
    if sizes["n"] == 0:
        scored = spark.createDataFrame([], schema)
    elif sizes["n"] <= block:
        asked = queries.toArrow().combine_chunks()  # no more than a block
        fit = rows
        for name in EQUAL:  # a filter all queries have reaches the scan
            values = set(asked.column(name).to_pylist()) if name in queries.columns else {None}
            if None not in values:
                fit = fit.where(F.col(EQUAL[name]).isin(*values))
        scored = fit.mapInArrow(_score(spark.sparkContext.broadcast(asked), k), schema)
    else:
        scored = _in_a_grid(queries, rows, k, -(-sizes["n"] // block), schema)
    order = [F.col("similarity").desc_nulls_last(), F.col("id")]
    salted = scored.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    first = Window.partitionBy("query_id", "_part").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k)
    last = Window.partitionBy("query_id").orderBy(*order)
    ranked = kept.drop("_part", "_rank").withColumn("rank", F.row_number().over(last))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def similar_many(corpus: DataFrame, wanted: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``id, rank, neighbour_id, similarity``: the ``k`` nearest rows of every wanted ``id``.

    An item is not its own neighbour. An id that is unknown or has no vector has no
    neighbours. Rows without a direction rank last, without a similarity; an item
    without one has all its neighbours so. ``corpus`` should be stored.
    """
    rows = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    asked = rows.join(wanted.select("id").distinct(), "id", "left_semi")
    asked = settle(asked.withColumnRenamed("id", "query_id"), "asked")
    found = rank_many(asked, rows, k + 1, block).where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("query_id").alias("id"), "rank", F.col("id").alias("neighbour_id"), "similarity"
    )


def nearest_rows(
    rows: DataFrame,
    vector: Sequence[float],
    k: int = fixed.TOP_K_DEFAULT,
    condition: Column | None = None,
) -> DataFrame:
    """The ``k`` rows nearest to one vector, with ``similarity``: a scan and a bounded sort."""
    rows = rows.where(F.col("embedding").isNotNull())
    rows = rows if condition is None else rows.where(condition)
    return (
        rows.withColumn("similarity", similarity_to(F.col("embedding"), vector))
        .orderBy(F.col("similarity").desc_nulls_last(), "id")
        .limit(k)
    )
