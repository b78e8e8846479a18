"""The six questions a catalog answers, over one stored table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions.text import with_prefix
from catalith.operators import search, stats, titles, validate
from catalith.operators.embed import ModelFactory, embed_batches


@dataclass
class Catalog:
    """A stored table, and the model its vectors came from.

    The methods answer one request. For a table of requests use
    :meth:`answer`, or ``search_many``, ``title_match`` and ``lookup_many``.
    """

    items: DataFrame
    model: ModelFactory
    dim: int = fixed.EMBEDDING_DIM
    top_k_max: int = fixed.TOP_K_MAX
    high_rating: float = fixed.HIGH_RATING

    def _request(self, kind: str, **values) -> DataFrame:
        """The request as a checked one-row table."""
        spark: SparkSession = self.items.sparkSession
        row = spark.range(1).select(
            *[F.lit(value).alias(name) for name, value in values.items() if value is not None],
            *[
                F.lit(None).cast("string").alias(name)
                for name, value in values.items()
                if value is None and name in ("query", "title", "movie_id")
            ],
        )
        validate.check_arguments(row, kind)
        refused = row.select(validate.rejection_reason(row, kind).alias("reason")).first()
        if refused["reason"]:
            raise ValueError(refused["reason"])
        return row

    def search_movies_by_description(
        self,
        query: str,
        top_k: int = fixed.TOP_K_DEFAULT,
        genre_filter: str | None = None,
        min_imdb_rating: float | None = None,
        mpaa_rating: str | None = None,
        decade: int | None = None,
    ) -> DataFrame:
        """Ranked items for a sentence; filters given here win over those it names."""
        request = self._request(
            "search",
            query=query,
            top_k=top_k,
            genre_filter=genre_filter,
            min_imdb_rating=min_imdb_rating,
            mpaa_rating=mpaa_rating,
            decade=decade,
        )
        row = (
            search.extract_filters(request, high_rating=self.high_rating)
            .withColumn("_text", with_prefix(F.col("query"), fixed.QUERY_PREFIX))
            .first()
        )
        vector = embed_batches(self.model(), [row["_text"]], self.dim, 1)[0].tolist()
        filters = search.Filters(
            row["genre_filter"], row["decade"], row["min_imdb_rating"], row["mpaa_rating"]
        )
        return search.hybrid_search(self.items, vector, filters, top_k, self.top_k_max)

    def get_movie_by_title(self, title: str) -> DataFrame:
        """At most one row: exact, else the best fuzzy match."""
        self._request("title", title=title)
        return titles.title_lookup(self.items, title)

    def get_movie_by_id(self, movie_id: str) -> DataFrame:
        """At most one row; none for a malformed id."""
        self._request("id", movie_id=movie_id)
        return search.lookup_by_id(self.items, movie_id)

    def get_similar_movies(
        self, movie_id: str, top_k: int = fixed.TOP_K_SIMILAR
    ) -> DataFrame:
        """Nearest items to one; none for an unknown or malformed id."""
        request = self._request("similar", movie_id=movie_id, top_k=top_k)
        ident = request.select(search.canonical_id(F.col("movie_id")).alias("id")).first()["id"]
        return search.similar_items(self.items, ident, top_k, self.top_k_max)

    def list_genres(self) -> DataFrame:
        return stats.list_facets(self.items)

    def get_dataset_stats(self) -> DataFrame:
        return stats.dataset_stats(self.items)

    def answer(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Results for a table of search requests, and the refused ones with a reason."""
        good, refused = validate.split_requests(requests, "search")
        found = search.search_sentences(
            self.items, good, self.model, self.dim, self.top_k_max, self.high_rating
        )
        return found, refused
