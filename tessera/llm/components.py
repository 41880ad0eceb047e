"""Connected components of an edge table, by alternating large and small stars.

Every step is a group-by and a join, each state is a stored table, and nothing is collected; the number of
steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _least(near: DataFrame) -> DataFrame:
    return near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least neighbour."""
    near = _both(edges)
    return near.join(_least(near), "u").where("v > u and v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tied = down.join(_least(down), "u")
    return tied.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): for every node that has an edge the least node of its component.

    Loops, repeated and null edges don't matter; without edges the result is empty.
    """
    now = stored(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = stored(small_star(large_star(now)))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("b").alias("v"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("v"), F.col("a").alias("root"))).distinct()
