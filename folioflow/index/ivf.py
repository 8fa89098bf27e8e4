"""Vectors by cell: a search reads the cells near its queries, and goes on to those that could still hold something nearer.

Cells are the directions of a k-means on a bounded sample; every vector is written to the directory of the cell whose direction is nearest. A cell
knows the widest angle of its vectors, so a query's angle to the direction bounds the distance of all that is in it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators.lexical import top
from folioflow.operators.sized import QUERY_BLOCK, blocks
from folioflow.operators.vector import dot, near_by_cell, norm, spread
from folioflow.sources.store import Store, stored

#: Vectors that cells are fitted on, and how many cells there are at most.
SAMPLE, MAX_CELLS, ROUNDS = 20_000, 4096, 12
#: The cell of vectors without a direction.
NOWHERE = -1
#: Distances are told to nine digits.
SLACK = 1e-8


def directions(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit vectors that the sample's (unit) vectors gather round; fewer than ``cells`` where the sample is smaller."""
    rng = np.random.default_rng(seed)
    found = sample[np.sort(rng.permutation(len(sample))[:cells])].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + 4096] @ found.T).argmax(axis=1) for a in range(0, len(sample), 4096)]) if len(sample) else np.zeros(0, int)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


class VectorIndex:
    """Rows with an id, a vector and whatever other columns, by cell, under a path."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        self.spark, self.store, self.id_col, self.vec_col = spark, Store(spark, path), id_col, vec_col

    def build(self, vectors: DataFrame, cells: int | None = None) -> None:
        """A new state from all rows; readers of the one before are not disturbed. Rows with a null vector are left out, those without a direction have a cell of their own."""
        rows = vectors.where(F.col(self.vec_col).isNotNull())
        cells = min(MAX_CELLS, cells or max(1, round(rows.count() ** 0.5)))
        drawn = rows.orderBy(F.xxhash64(self.id_col), self.id_col).limit(SAMPLE).select(F.transform(self.vec_col, lambda x: x.cast("double")).alias("v")).toPandas()["v"]
        sample = np.array([x for x in drawn if len(x) and np.linalg.norm(x) > 0])
        found = directions(sample / np.linalg.norm(sample, axis=1, keepdims=True), cells) if len(sample) else np.zeros((0, 0))
        shared = self.spark.sparkContext.broadcast(found)

        @F.pandas_udf("struct<cell int, angle double>")
        def nearest(col: pd.Series) -> pd.DataFrame:
            x = np.array(col.tolist(), float).reshape(len(col), -1)
            size = np.linalg.norm(x, axis=1)
            near = (x / np.where(size > 0, size, 1)[:, None]) @ shared.value.T if len(shared.value) else np.zeros((len(x), 1))
            cell = np.where(size > 0, near.argmax(axis=1), NOWHERE)
            return pd.DataFrame({"cell": cell.astype("int32"), "angle": np.arccos(np.clip(near.max(axis=1), -1, 1))})

        def write(path: str) -> None:
            placed = spread(rows).withColumn("_at", nearest(self.vec_col)).select(*rows.columns, F.col("_at.cell").alias("cell"), F.col("_at.angle").alias("angle"))
            # a cell that a third of all rows fall into is written by several tasks
            placed.repartition("cell", F.pmod(F.xxhash64(self.id_col), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/vectors")
            table = [(i, c.tolist()) for i, c in enumerate(found)] + [(NOWHERE, None)]
            told = self.spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"))
            self.spark.createDataFrame(table, "cell int, direction array<double>").join(told, "cell").coalesce(1).write.parquet(f"{path}/cells")

        self.store.rebuild(write)

    def cells(self) -> DataFrame:
        """(cell, direction, n, angle); at most ``MAX_CELLS`` and one."""
        return self.spark.read.parquet(f"{self.store.part(self.store.parts()[-1])}/cells")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.part(self.store.parts()[-1])}/vectors")

    def reach(self, queries: DataFrame) -> DataFrame:
        """(query_id, cell, least, place): the least distance that a cell's vectors can have from a query, and the cell's place among the query's."""
        asked = spread(queries.select("query_id", "query_vec", norm(F.col("query_vec")).alias("_q")))
        met = asked.join(F.broadcast(self.cells()))
        away = _angle(dot(F.col("query_vec"), F.col("direction")) / F.col("_q"))
        least = 1 - F.cos(F.greatest(away - F.col("angle"), F.lit(0.0)))
        # without a direction, of the query or of the vectors, every distance is 1
        least = F.when((F.col("_q") == 0) | F.col("direction").isNull(), F.lit(1.0)).otherwise(least)
        order = F.when((F.col("_q") == 0) | F.col("direction").isNull(), F.lit(1.0)).otherwise(1 - F.cos(away))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "cell"))
        return met.select("query_id", "cell", least.alias("least"), place.alias("place"))

    def _met(self, queries: DataFrame, cells: DataFrame, where: Column | None, k: int = 1) -> DataFrame:
        """Each query's k nearest rows of each task, among its cells' rows: queries go to tasks a block at a time, rows are compared in matrices by cell."""
        rows = self.vectors() if where is None else self.vectors().where(where)
        met = []
        for block in blocks(queries.select("query_id", "query_vec"), "query_id", QUERY_BLOCK):
            wanted = cells.join(F.broadcast(block.select("query_id")), "query_id", "left_semi")
            met.append(near_by_cell(rows, block, wanted, k, self.id_col, self.vec_col))
        return reduce(DataFrame.unionByName, met)

    def search(self, queries: DataFrame, k: int, probe: int = 8, exact: bool = True, where: Column | None = None) -> DataFrame:
        """(query_id, id, distance, rank): the k nearest rows of each query by 1 - cosine, ties by id.

        The ``probe`` nearest cells of each query are read first. If ``exact``, so are those whose least distance is not above that of the query's
        k-th row by then; otherwise they are left. ``where`` is a condition on the rows, applied by the scan.
        """
        reach = stored(self.reach(queries), "reach")
        best = stored(top(self._met(queries, reach.where(F.col("place") <= probe), where, k), "query_id", "distance", self.id_col, k, descending=False), "nearest")
        if not exact:
            return best
        most = best.where(F.col("rank") == k).select("query_id", F.col("distance").alias("most"))
        rest = reach.where(F.col("place") > probe).join(most, "query_id", "left").where(F.col("most").isNull() | (F.col("least") <= F.col("most") + SLACK))
        rest = stored(rest.select("query_id", "cell"), "reach")
        return top(best.drop("rank").unionByName(self._met(queries, rest, where, k)), "query_id", "distance", self.id_col, k, descending=False)
