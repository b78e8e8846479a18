"""Search: filters, ranking by cosine similarity, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions import sentences
from catalith.operators.embed import ModelFactory, embed_queries, spread
from catalith.operators.nearest import QUERY_BLOCK, nearest_rows, rank_many
from catalith.session import settle


@dataclass(frozen=True)
class Filters:
    """Optional filters; ``None`` leaves one out."""

    genre_filter: str | None = None
    decade: int | None = None
    min_imdb_rating: float | None = None
    mpaa_rating: str | None = None
    observed_only: bool = False

    def condition(self) -> Column:
        keep = F.col("embedding").isNotNull()
        if self.genre_filter is not None:
            keep = keep & (F.col("major_genre") == self.genre_filter)
        if self.decade is not None:
            keep = keep & (F.col("decade") == self.decade)
        if self.min_imdb_rating is not None:
            keep = keep & (F.col("imdb_rating") >= self.min_imdb_rating)
            if self.observed_only:
                keep = keep & ~F.coalesce("imdb_rating_imputed", F.lit(False))
        if self.mpaa_rating is not None:
            keep = keep & (F.col("mpaa_rating") == self.mpaa_rating)
        return keep


def clamp_top_k(
    k: Column | int | None, most: int = fixed.TOP_K_MAX, default: int = fixed.TOP_K_DEFAULT
) -> Column | int:
    """A number of results between 1 and ``most``; a missing one is the default."""
    if k is None or isinstance(k, int):
        return max(1, min(default if k is None else k, most))
    return F.greatest(F.lit(1), F.least(F.coalesce(k, F.lit(default)), F.lit(most)))


def as_results(
    df: DataFrame, similarity: Column, match_type: Column | str, extra: Sequence[str] = ()
) -> DataFrame:
    """The fixed result columns, preceded by ``extra``."""
    values = {
        "id": F.col("id").cast("string"),
        "title": F.coalesce("title", F.lit("")),
        "release_year": F.col("release_year").cast("int"),
        "imdb_rating": F.col("imdb_rating").cast("double"),
        "rt_rating": F.col("rt_rating").cast("int"),
        "similarity": similarity.cast("double"),
        "match_type": F.lit(match_type),
    }
    return df.select(*extra, *[values.get(c, F.col(c)).alias(c) for c in fixed.RESULT_COLUMNS])


def hybrid_search(
    corpus: DataFrame,
    vector: Sequence[float],
    filters: Filters = Filters(),
    top_k: int = fixed.TOP_K_DEFAULT,
    most: int = fixed.TOP_K_MAX,
) -> DataFrame:
    """Filter, rank by cosine similarity, keep ``top_k``. Filters come first."""
    kept = corpus.where(filters.condition())
    found = nearest_rows(kept, vector, clamp_top_k(top_k, most))
    return as_results(found, F.col("similarity"), "semantic")


def vector_of(corpus: DataFrame, item_id) -> list[float] | None:
    """The vector of one item; None for an unknown id or a missing vector."""
    row = corpus.where(F.col("id") == F.lit(item_id)).select("embedding").head()
    return None if row is None or row["embedding"] is None else list(row["embedding"])


def similar_items(
    corpus: DataFrame,
    item_id,
    top_k: int = fixed.TOP_K_SIMILAR,
    most: int = fixed.TOP_K_MAX,
) -> DataFrame:
    """Nearest items to a stored one, itself left out; none without its vector."""
    source = vector_of(corpus, item_id)
    others = corpus.where(F.col("id") != F.lit(item_id))
    if source is None:
        return as_results(corpus.where(F.lit(False)), F.lit(None), "semantic")
    k = clamp_top_k(top_k, most, fixed.TOP_K_SIMILAR)
    return as_results(nearest_rows(others, source, k), F.col("similarity"), "semantic")


def canonical_id(value: Column) -> Column:
    """Lower-case hyphenated form of a UUID; NULL for anything else."""
    bare = F.regexp_replace(value, r"urn:|uuid:", "")
    digits = F.lower(F.regexp_replace(F.regexp_replace(bare, r"\A[{}]+|[{}]+\z", ""), "-", ""))
    whole = F.regexp_extract(digits, r"\A[0-9a-f]{32}\z", 0)
    return F.when(
        whole != "",
        F.regexp_replace(whole, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5"),
    )


def lookup_by_id(corpus: DataFrame, item_id: str) -> DataFrame:
    """One item by its id; a malformed id finds nothing."""
    found = corpus.where(F.col("id") == canonical_id(F.lit(item_id)))
    return as_results(found, F.lit(None), "lookup")


def lookup_many(corpus: DataFrame, requests: DataFrame) -> DataFrame:
    """Items for a table of ``request_id, movie_id``.

    Ids asked for are made distinct first, so a popular id is joined once.
    """
    asked = requests.select("request_id", canonical_id(F.col("movie_id")).alias("id")).where(
        F.col("id").isNotNull()
    )
    found = corpus.join(asked.select("id").distinct(), "id", "left_semi")
    hits = as_results(found, F.lit(None), "lookup")
    return asked.join(hits, "id").select("request_id", *fixed.RESULT_COLUMNS)


def extract_filters(
    requests: DataFrame, query: str = "query", high_rating: float = fixed.HIGH_RATING
) -> DataFrame:
    """Adds the four filters; a given value wins over what the sentence says.

    Sentences are dealt out first: reading one takes some thirty patterns, and a table of short
    texts is one file that one task would read.
    """
    sentence = F.col(query)
    said = {
        "genre_filter": (sentences.genre_of(sentence), "string"),
        "decade": (sentences.decade_of_sentence(sentence), "int"),
        "min_imdb_rating": (sentences.rating_floor_of(sentence, high_rating), "double"),
        "mpaa_rating": (sentences.rating_label_of(sentence), "string"),
    }
    resolved = {}
    for name, (value, kind) in said.items():
        given = [F.col(name)] if name in requests.columns else []
        resolved[name] = F.coalesce(*given, value).cast(kind)
    return spread(requests).withColumns(resolved)


def search_many(
    corpus: DataFrame,
    queries: DataFrame,
    most: int = fixed.TOP_K_MAX,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """Hybrid search for a table ``query_id, embedding, top_k`` and the four filters.

    Query ids must be distinct. Only ids, vectors and filter columns are scored; the
    result columns are fetched for the winners afterwards. A missing ``top_k`` is the default.
    """
    asked = settle(
        queries.select(
            "query_id",
            "embedding",
            F.col("genre_filter").cast("string").alias("genre_filter"),
            F.col("decade").cast("int").alias("decade"),
            F.col("min_imdb_rating").cast("double").alias("min_imdb_rating"),
            F.col("mpaa_rating").cast("string").alias("mpaa_rating"),
            clamp_top_k(F.col("top_k"), most).alias("_k"),
        ),
        "asked",
    )
    rows = corpus.where(F.col("embedding").isNotNull()).select(
        "id",
        "embedding",
        F.col("major_genre").cast("string").alias("major_genre"),
        F.col("decade").cast("int").alias("decade"),
        F.col("imdb_rating").cast("double").alias("imdb_rating"),
        F.col("mpaa_rating").cast("string").alias("mpaa_rating"),
    )
    wanted = asked.select("query_id", "_k")
    most = wanted.agg(F.max("_k")).first()[0] or 1  # none is asked for more
    found = rank_many(asked.drop("_k"), rows, most, block)
    best = settle(
        found.join(wanted, "query_id").where(F.col("rank") <= F.col("_k")).drop("_k"), "best"
    )
    details = corpus.drop("embedding", "similarity")
    return as_results(
        best.join(details, "id"), F.col("similarity"), "semantic", extra=("query_id", "rank")
    )


def search_sentences(
    corpus: DataFrame,
    requests: DataFrame,
    factory: ModelFactory,
    dim: int = fixed.EMBEDDING_DIM,
    most: int = fixed.TOP_K_MAX,
    high_rating: float = fixed.HIGH_RATING,
) -> DataFrame:
    """Sentences to ranked rows: extract filters, embed the sentence, search."""
    resolved = extract_filters(requests, high_rating=high_rating)
    if "top_k" not in resolved.columns:
        resolved = resolved.withColumn("top_k", F.lit(fixed.TOP_K_DEFAULT))
    return search_many(corpus, embed_queries(resolved, factory=factory, dim=dim), most)
