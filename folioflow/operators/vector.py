"""Exact cosine search by stated query vectors, and an optional random-projection index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from folioflow.operators.lexical import top
from folioflow.operators.sized import QUERY_BLOCK, blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Rows whose distances from a block of queries a task holds at once.
ROWS_AT_ONCE = 512


class _Nearest:
    """The k nearest rows of each query among all that a task has met: distances are told to nine digits, ties go by id."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.most = k, np.full(n_queries, np.inf)
        self.at, self.distance, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        self.waiting, self.n_waiting = [], 0

    def meet(self, ids: np.ndarray, distance: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Rows' distances, (rows, queries), from all queries or those at these places; one that is no number comes last."""
        distance = np.where(np.isnan(distance), np.inf, distance)
        most = self.most if queries is None else self.most[queries]
        if len(ids) > self.k:
            most = np.minimum(most, np.partition(distance, self.k - 1, axis=0)[self.k - 1])
        row, at = np.nonzero(distance <= most)
        self.waiting.append((at if queries is None else queries[at], distance[row, at], ids[row]))
        self.n_waiting += len(at)
        if self.n_waiting > 4 * self.k * len(self.most):
            self.settle()

    def settle(self) -> None:
        kept = [(self.at, self.distance, self.ids)] if self.ids is not None else []
        parts = [*kept, *self.waiting]
        self.waiting, self.n_waiting = [], 0
        if not parts:
            return
        at, distance, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, distance, at))
        at, distance, ids = at[order], distance[order], ids[order]
        first = np.searchsorted(at, np.arange(len(self.most)))
        place = np.arange(len(at)) - first[at]
        last = place == self.k - 1
        self.most[at[last]] = distance[last]
        self.at, self.distance, self.ids = (x[place < self.k] for x in (at, distance, ids))


def _near(rows: DataFrame, asked: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, id, distance) of what each task holds the k nearest of each query by; the queries go to every task, and of the rows no more than that is passed on."""
    told = asked.where(F.col("query_vec").isNotNull()).select("query_id", F.col("query_vec").cast("array<double>")).toArrow()
    query_ids = told["query_id"].combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, _unit(told["query_vec"].combine_chunks()) if len(told) else None))
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField(id_col, rows.schema[id_col].dataType), StructField("distance", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = shared.value
        found, id_type = _Nearest(len(keys), k), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                found.meet(ids.astype(str) if ids.dtype == object else ids, np.round(1 - _unit(part.column(1)) @ q.T, 9) + 0.0)  # no -0.0
        found.settle()
        if found.ids is not None and len(found.ids):
            lost = np.isinf(found.distance)
            distance = pa.array(np.where(lost, np.nan, found.distance))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found.at)), pa.array(found.ids).cast(id_type), distance], names=["query_id", id_col, "distance"])

    if not len(query_ids):
        return rows.sparkSession.createDataFrame([], schema)
    as_wide = F.size(vec_col) == len(told["query_vec"][0])
    return rows.where(as_wide).select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(run, schema)


def near_by_cell(rows: DataFrame, asked: DataFrame, wanted: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, id, distance) of what each task holds the k nearest of each query by, where rows have a ``cell`` and ``wanted`` is (query_id, cell).

    The queries go to every task, with a bit for each query and cell: a block of queries by at most some thousand cells.
    """
    told = asked.where(F.col("query_vec").isNotNull()).select("query_id", F.col("query_vec").cast("array<double>")).toArrow()
    query_ids = told["query_id"].combine_chunks()
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField(id_col, rows.schema[id_col].dataType), StructField("distance", DoubleType())])
    numbers = {x: i for i, x in enumerate(query_ids.to_pylist())}
    # places of a cell's queries, one bit each; packed by tasks, so a cell is one row of some hundred bytes here
    places = rows.sparkSession.createDataFrame([(x, i) for x, i in numbers.items()], StructType([schema[0], StructField("_at", LongType())])) if numbers else None
    marks = {}
    if numbers:
        found = wanted.join(F.broadcast(places), "query_id").groupBy("cell", F.floor(F.col("_at") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_at % 32 AS INT))")).alias("bits")).toArrow()
        cells, words, bits = (found[c].to_numpy() for c in ("cell", "word", "bits"))
        for cell in np.unique(cells):
            mine, packed = cells == cell, np.zeros(-(-len(numbers) // 32), "<u4")
            packed[words[mine]] = bits[mine].astype("<u4")
            marks[int(cell)] = packed
    if not marks:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, _unit(told["query_vec"].combine_chunks()), marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, marks = shared.value
        found, id_type = _Nearest(len(keys), k), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells):
                at = np.flatnonzero(np.unpackbits(marks[int(cell)].view(np.uint8), bitorder="little")[: len(keys)])
                mine = batch.take(pa.array(np.flatnonzero(cells == cell)))
                for start in range(0, mine.num_rows, ROWS_AT_ONCE):
                    part = mine.slice(start, ROWS_AT_ONCE)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    found.meet(ids.astype(str) if ids.dtype == object else ids, np.round(1 - _unit(part.column(1)) @ q[at].T, 9) + 0.0, at)
        found.settle()
        if found.ids is not None and len(found.ids):
            lost = np.isinf(found.distance)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found.at)), pa.array(found.ids).cast(id_type), pa.array(np.where(lost, np.nan, found.distance))], names=["query_id", id_col, "distance"])

    wide = F.size(vec_col) == len(told["query_vec"][0])
    met = rows.where(F.col("cell").isin(sorted(marks)) & wide).select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col), "cell")  # a partition filter: other cells' files are not opened
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    # in a task rows of a cell lie together, and a cell that holds many rows goes to several tasks
    return met.repartition(tasks, "cell", F.pmod(F.xxhash64(id_col), F.lit(8))).sortWithinPartitions("cell").mapInArrow(run, schema)


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1; without a direction rows of zeros."""
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def knn(vectors: DataFrame, queries: DataFrame, k: int, allowed: list | None = None, id_col: str = "vec_id", vec_col: str = "embedding", filter_col: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query by 1 - cosine, ties by id. Rows with a null vector, or one of another width than the queries', are left out.

    ``queries`` (query_id, query_vec) is a stated set and goes to the scan, ``sized.QUERY_BLOCK`` vectors for each pass;
    ``allowed`` values of ``filter_col`` are a predicate on the scan, before any distance. Every row meets every query; a task passes on
    its own k nearest of each query, so what is shuffled goes by tasks and not by rows.
    """
    rows = vectors if allowed is None else vectors.where(F.col(filter_col or id_col).isin(allowed))
    rows = spread(rows.select(id_col, vec_col))
    met = [_near(rows, part, k, id_col, vec_col) for part in blocks(queries.select("query_id", "query_vec"), "query_id", QUERY_BLOCK)]
    return top(reduce(DataFrame.unionByName, met), "query_id", "distance", id_col, k, descending=False)


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to all cores: a table of vectors is few splits of a file, and every row of it is compared with every query."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def dense_score(distance: Column, most: float = 2.0) -> Column:
    """1 at distance 0, falling to 0 at ``most`` and staying there."""
    return F.when(distance <= most, 1 - distance / most).otherwise(F.lit(0.0))


def lsh_index(vectors: DataFrame, vec_col: str = "embedding", bucket: float = 0.5, tables: int = 8, seed: int = 42):
    """A fitted random-projection model over normalised vectors and the indexed rows; for approximate search by ``model.approxNearestNeighbors``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = Normalizer(inputCol="_raw", outputCol="features").transform(vectors.withColumn("_raw", array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))))).drop("_raw")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    return model, model.transform(rows)
