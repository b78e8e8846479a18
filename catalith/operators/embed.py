"""Embedding: task prefix, fixed-size batches, an injected model, strict checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith import fixed
from catalith.functions.text import with_prefix

# Texts one task embeds at most, and the fewest that are worth a task.
ROWS_PER_TASK = 20_000
LEAST_ROWS = 256

Model = Callable[[list[str]], Sequence[Sequence[float]]]
ModelFactory = Callable[[], Model]


def embed_batches(model: Model, texts: list[str], dim: int, batch: int) -> np.ndarray:
    """A row per text, ``batch`` texts per call; a wrong answer raises."""
    parts = []
    for start in range(0, len(texts), max(1, batch)):
        asked = texts[start : start + max(1, batch)]
        answer = model(asked)
        if len(answer) != len(asked):
            raise ValueError(f"{len(asked)} texts came back as {len(answer)} vectors")
        for length in {len(vector) for vector in answer}:
            if length != dim:
                raise ValueError(f"a vector has {length} numbers, not {dim}")
        parts.append(np.asarray(answer, dtype=np.float32))
    return np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)


def embedding_of(
    text: Column,
    factory: ModelFactory,
    dim: int = fixed.EMBEDDING_DIM,
    batch: int = fixed.EMBEDDING_BATCH,
) -> Column:
    """Vector of each text. The model is built once per task; NULL stays NULL.

    A wrong answer fails the task, and Spark's task retry is the retry.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType(), containsNull=False))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = None
        for texts in parts:
            asked = texts.drop_null().to_pylist()
            found = np.zeros((0, dim), np.float32)
            if asked:
                model = model or factory()
                found = embed_batches(model, asked, dim, batch)
            given = pc.is_valid(texts).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(given)]) * dim
            offsets = pa.array(ends, pa.int32(), mask=np.append(~given, False))
            yield pa.ListArray.from_arrays(offsets, pa.array(found.ravel(), pa.float32()))

    return run(text)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before they go to the model.

    A model call costs far more than moving its text, and a few large files would
    keep most cores idle. Tasks stay small enough to be worth redoing.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil(rows / ROWS_PER_TASK), min(cores, math.ceil(rows / LEAST_ROWS)))
    return df.repartition(max(1, tasks))


def embed_documents(
    df: DataFrame,
    text: str = "augmented_text",
    out: str = "embedding",
    *,
    factory: ModelFactory,
    dim: int = fixed.EMBEDDING_DIM,
    batch: int = fixed.EMBEDDING_BATCH,
    prefix: str = fixed.DOCUMENT_PREFIX,
) -> DataFrame:
    """Adds the vector of a text column, prefixed for documents."""
    return df.withColumn(out, embedding_of(with_prefix(F.col(text), prefix), factory, dim, batch))


def embed_queries(df: DataFrame, text: str = "query", **options) -> DataFrame:
    """The same for query sentences, with their own prefix."""
    return embed_documents(df, text, prefix=fixed.QUERY_PREFIX, **options)
