"""Connected components by alternating large and small stars, and the texts of candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, written


def _min_of_neighbours(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v <= u")
    near = both.join(_min_of_neighbours(both), "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select("u", F.col("m").alias("v")).unionByName(near.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node with an edge the least node that it reaches.

    Each step reads the edges from the shared folder and writes the next ones there, in a number of steps
    that grows with the logarithm of the nodes. A node with very many edges is a row for each of them.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    told = None
    while True:
        # edges are distinct, so their number and two 64-bit marks of the set tell whether a step has changed it
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if tuple(mark) == told or not mark[0]:
            break
        told = tuple(mark)
        last, now = now, written(_star(_star(now, large=True), large=False), "edges")
        dropped(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
