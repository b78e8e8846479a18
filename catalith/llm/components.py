"""Connected components of a graph of any size, as joins and aggregations.

Each round hangs every larger neighbour of a node, then every smaller one, below the
smallest node it can see, until nothing moves: the number of rounds grows with the
logarithm of the longest path. Smallest neighbours are found by an aggregation that
sums up in each task first, so a node with very many links costs no more than its
links. Each round is a table in the shared folder; the one before it is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import Scratch, settle


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half round on pairs ``u > v``."""
    if larger:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    told = both.join(least, "u")
    if larger:
        moved = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = told.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u > v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` of every node with a link; the component is its smallest node.

    Links have no direction. Links with a null end and links of a node to itself count
    for nothing; repeated links count once.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with Scratch(spark, "components") as scratch:
        now = scratch.settle(pairs, "links")
        while True:
            large = scratch.settle(_star(now, larger=True), "large")
            after = scratch.settle(_star(large, larger=False), "small")
            scratch.drop(large)
            marks = [
                df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
                for df in (now, after)
            ]
            scratch.drop(now)
            now = after
            if marks[0] == marks[1]:
                break
        found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
            now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        )
        return settle(found, "components")
