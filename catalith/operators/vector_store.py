"""Vectors that are kept, so that a later run asks the model for new texts only.

A vector belongs to a digest of the model's name, the task prefix and the text. A run takes the distinct
texts, leaves out those the store has (an anti-join on digests, no texts or vectors are moved for it),
embeds the rest and appends them; then every row gets its vector by digest. Equal texts are asked
once, in one run and over all runs.

Appends are Spark's own: a run that fails leaves nothing of it behind. Two runs that embed one text at the
same time both store it; readers take one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions.text import with_prefix
from catalith.operators.embed import ModelFactory, embedding_of, spread
from catalith.session import path_exists, settle

_SCHEMA = "digest binary, embedding array<float>"


class VectorStore:
    """The vectors of one model. ``model`` names it with its version: another name shares nothing."""

    def __init__(self, spark: SparkSession, path: str, model: str) -> None:
        self._spark = spark
        self.path = path.rstrip("/")
        self.model = model

    def digest(self, text: Column, prefix: str) -> Column:
        """What a vector is kept under; NULL for a NULL text."""
        parts = [F.lit(self.model), F.lit(prefix), text]
        lengths = [F.octet_length(part).cast("string") for part in parts[:2]]
        return F.unhex(F.sha2(F.concat(*lengths, F.lit(":"), *parts), 256))

    def read(self) -> DataFrame:
        """``digest, embedding`` of everything stored, each digest once."""
        if not path_exists(self._spark, self.path):
            return self._spark.createDataFrame([], _SCHEMA)
        kept = self._spark.read.schema(_SCHEMA).parquet(self.path)
        return kept.dropDuplicates(["digest"])

    def _digests(self) -> DataFrame:
        if not path_exists(self._spark, self.path):
            return self._spark.createDataFrame([], "digest binary")
        return self._spark.read.schema("digest binary").parquet(self.path)

    def add_missing(
        self,
        texts: DataFrame,
        text: str,
        *,
        factory: ModelFactory,
        dim: int = fixed.EMBEDDING_DIM,
        batch: int = fixed.EMBEDDING_BATCH,
        prefix: str = fixed.DOCUMENT_PREFIX,
    ) -> int:
        """Embed the texts the store lacks; how many they were."""
        given = texts.select(self.digest(F.col(text), prefix).alias("digest"), F.col(text).alias("text"))
        given = given.where(F.col("digest").isNotNull())
        known = self._digests()
        lacking = given.join(known, "digest", "left_anti").dropDuplicates(["digest"])
        lacking = settle(lacking, "lacking")
        n = lacking.count()
        if n:
            vector = embedding_of(with_prefix(F.col("text"), prefix), factory, dim, batch)
            spread(lacking).select("digest", vector.alias("embedding")).write.mode("append").parquet(self.path)
        return n

    def embed(
        self,
        df: DataFrame,
        text: str = "augmented_text",
        out: str = "embedding",
        *,
        factory: ModelFactory,
        dim: int = fixed.EMBEDDING_DIM,
        batch: int = fixed.EMBEDDING_BATCH,
        prefix: str = fixed.DOCUMENT_PREFIX,
    ) -> DataFrame:
        """``df`` with the vector of each text, as ``embed_documents`` gives it.

        The rows should be stored: they are read for what is missing, and again for the result. Only
        digests of these rows meet the store, so the vectors moved are those the result has.
        """
        self.add_missing(df, text, factory=factory, dim=dim, batch=batch, prefix=prefix)
        marked = df.withColumn("_digest", self.digest(F.col(text), prefix))
        wanted = marked.select(F.col("_digest").alias("digest")).where("digest IS NOT NULL").distinct()
        found = self.read().join(wanted, "digest", "left_semi")
        found = found.select(F.col("digest").alias("_digest"), F.col("embedding").alias(out))
        return marked.drop(out).join(found, "_digest", "left").drop("_digest")
