"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column, dim: int) -> Column:
    """A float array from ``"[a,b,...]"``; any other length fails the job."""
    body = F.regexp_replace(F.trim(text), r"\A\[|\]\z", "")
    parts = F.filter(F.split(body, ","), lambda part: F.trim(part) != "")
    vector = F.transform(parts, lambda part: F.trim(part).cast("float"))
    return checked_vector(vector, dim)


def checked_vector(vector: Column, dim: int) -> Column:
    """The vector itself; a missing one or a wrong length fails the job."""
    wrong = F.concat(
        F.lit(f"embedding length is not {dim}: "),
        F.coalesce(F.size(vector).cast("string"), F.lit("null")),
    )
    return F.when(F.size(vector) == dim, vector).otherwise(
        F.raise_error(wrong).cast("array<float>")
    )
