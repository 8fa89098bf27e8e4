"""Product codes of vectors; the nearest codebook entry is found by a VA-file filter over the entries.

Every coordinate of a codebook's entries is quantised to a cell of three bits. For a query two lookup tables, by coordinate and cell, hold the least and
the greatest squared distance to the cell; their sums over an entry's cells are bounds of its distance. Entries whose lower bound is above
another's upper bound are out, and the rest are refined by exact integer distances. Bounds are rounded outwards, so they only filter.

Codebooks are trained by rounds over the whole table: each task adds up the parts of its rows, tasks' sums meet in one aggregation, and what
reaches the driver has the codebook's size. Sums of integers are exact, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import ship, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CELL_BITS = 3
#: Rows that are coded at once.
ROWS = 1024
#: Integers up to here have distances that 64 bits hold; beyond, Python's integers take over.
PLAIN = 1 << 27
#: What is stored for an error that 64 bits do not hold.
MOST = (1 << 63) - 1


@dataclass
class Entries:
    """One part's codebook and its approximation: cells of each coordinate, and the bounds of the cells."""

    values: np.ndarray  # (entries, width), int64 or object

    def __post_init__(self) -> None:
        v = self.values.astype(np.float64)
        n, width = v.shape
        cells = 1 << CELL_BITS
        by_rank = np.argsort(np.argsort(v, axis=0, kind="stable"), axis=0)
        cell = by_rank * cells // max(1, n)
        self.low, self.high = np.full((width, cells), np.inf), np.full((width, cells), -np.inf)
        columns = np.broadcast_to(np.arange(width), cell.shape)
        np.minimum.at(self.low, (columns, cell), v)
        np.maximum.at(self.high, (columns, cell), v)
        used = self.low <= self.high
        self.low, self.high = np.where(used, self.low, 0.0), np.where(used, self.high, 0.0)
        self.pick = np.zeros((width * cells, n), np.float32)  # an entry's cells, one of each coordinate
        self.pick[columns * cells + cell, np.arange(n)[:, None]] = 1

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the squared distance of every row to every entry."""
        x = rows.astype(np.float32)[:, :, None]
        low, high = self.low.astype(np.float32), self.high.astype(np.float32)
        under, over = low - x, x - high
        least = np.square(np.maximum(np.maximum(under, over), 0)).reshape(len(rows), -1)
        most = np.square(np.maximum(np.abs(under), np.abs(over))).reshape(len(rows), -1)
        return least @ self.pick, most @ self.pick

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row's nearest entry; the lower one on ties."""
        exact = rows.dtype == object or self.values.dtype == object
        if exact:  # floats say nothing at this size
            near = np.ones((len(rows), len(self.values)), bool)
            values, rows = self.values.astype(object), rows.astype(object)
        else:
            low, high = self.bounds(rows)
            # 32-bit floats: coordinates are rounded before they are squared, so the slack covers rounding relative to their size
            size = np.float32(max(1.0, float(np.abs(rows).max(initial=0)), float(np.abs(self.values).max(initial=0))))
            slack = np.float32(1e-5) * (high.min(axis=1, keepdims=True) + size)
            near = low - slack <= high.min(axis=1, keepdims=True) + slack
            if size > 1 << 20:
                near[:] = True
            values = self.values
        row, entry = np.nonzero(near)
        away = values[entry] - rows[row]
        distance = (away * away).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(rows)))
        best = np.minimum.reduceat(distance, first) if len(rows) else distance
        hit = np.flatnonzero(distance == np.repeat(best, np.diff(np.append(first, len(row)))))
        hit = hit[np.searchsorted(row[hit], np.arange(len(rows)))]  # entries of a row come in order
        return entry[hit], best


def integers(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their integers): a row is dropped if it or a component is null or not finite, or if it has not ``width`` components. Missing components up to a multiple of ``PARTS`` are 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.asarray(col.value_lengths().fill_null(-1))
    ok = sizes == width
    flat = col.filter(pa.array(ok)).flatten()
    x = np.asarray(flat.fill_null(np.nan).cast(pa.float64()) if flat.null_count else flat.cast(pa.float64())).reshape(-1, width)
    good = np.isfinite(x).all(axis=1)
    ok[np.flatnonzero(ok)[~good]] = False
    x = x[good]
    padded = -(-width // PARTS) * PARTS
    if np.abs(x).max(initial=0) * SCALE < PLAIN:
        out = np.zeros((len(x), padded), np.int64)
        out[:, :width] = np.floor(x * SCALE)
    else:
        out = np.zeros((len(x), padded), object)
        out[:, :width] = [[_floor(v) for v in r] for r in x.tolist()]
    return ok, out


def _floor(v: float) -> int:
    top, bottom = v.as_integer_ratio()
    return top * SCALE // bottom


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    return np.split(rows, PARTS, axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ok, rows = integers(part.column(part.schema.get_field_index("embedding")), width)
            if len(rows):
                yield part.filter(pa.array(ok)), rows


def _start(vectors: DataFrame) -> tuple[int, list[np.ndarray]]:
    """The width of vectors and the first codebooks: parts of the vectors with the least ids (null ids last), at most ``ENTRIES``."""
    clean = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    clean = clean.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    head = clean.orderBy(*order).limit(1).select(F.size("embedding").alias("width")).first()
    if head is None:
        return 0, []
    rows = clean.where(F.size("embedding") == head.width).select("vec_id", "embedding").orderBy(*order).limit(ENTRIES).toArrow()
    return head.width, _parts(integers(rows["embedding"], head.width)[1])


def _sums(vectors: DataFrame, width: int, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """How many parts are nearest to each entry and the sums of their components; entries without any are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    sub = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Entries(b) for b in shared.value]
        counts = [np.zeros(len(b), np.int64) for b in shared.value]
        sums: list[np.ndarray] = [np.zeros((len(b), sub), np.int64) for b in shared.value]
        for _, rows in _blocks(batches, width):
            for p, part in enumerate(_parts(rows)):
                code = entries[p].nearest(part)[0]
                if part.dtype == object or int(np.abs(sums[p]).max(initial=0)) > 1 << 61:
                    sums[p] = sums[p].astype(object)
                counts[p] += np.bincount(code, minlength=len(counts[p]))
                order = np.argsort(code, kind="stable")
                some, first = np.unique(code[order], return_index=True)
                if len(some):
                    sums[p][some] += np.add.reduceat(part[order], first, axis=0)
        got = [(p, e, int(counts[p][e]), [str(v) for v in sums[p][e].tolist()]) for p in range(PARTS) for e in np.flatnonzero(counts[p]).tolist()]
        columns = list(zip(*got, strict=True)) if got else [[], [], [], []]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "entry", "n", "sums"])

    told = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    each = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "v"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python's integers: sums may pass what a decimal holds
        total: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for p, e, at, n, v in zip(*(batch.column(c).to_pylist() for c in ("part", "entry", "at", "n", "v")), strict=True):
                x = total.setdefault((p, e, at), [0, 0])
                x[0] += n
                x[1] += int(v)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([str(total[k][1]) for k in keys])], names=["part", "entry", "at", "n", "v"])

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = each.repartition(min(tasks, PARTS * ENTRIES), "part", "entry").mapInArrow(added, "part int, entry int, at int, n long, v string")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in met.toArrow().to_pylist():  # as many rows as the codebooks have components
        out.setdefault((r["part"], r["entry"]), (r["n"], [0] * sub))[1][r["at"]] = int(r["v"])
    return out


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """The width of vectors and the trained codebooks of their parts."""
    width, books = _start(vectors)
    for _ in range(rounds if books else 0):
        found = _sums(vectors, width, books)
        values = [b.tolist() for b in books]
        for (p, e), (n, sums) in found.items():
            values[p][e] = [s // n for s in sums]
        plain = all(abs(v) < PLAIN for b in values for e in b for v in e)
        books = [np.array(b, np.int64 if plain else object) for b in values]
    return width, books


def digest(books: list[np.ndarray]) -> str:
    return sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row of vectors (vec_id, embedding, label).

    A row is not usable if its vector is null, empty, or holds null or non-finite components, or is of another length than the
    usable vector with the least vec_id. Parts are equal where 4 divides the length; else zeros are added up to there. Rows with a null vec_id
    come last in the order of the first entries, rows with equal vec_ids by their vectors. Fewer rows than entries make a smaller codebook. Errors over 64 bits
    count as the greatest 64-bit number. Other columns are not read; a table without usable rows gives none.
    """
    ship(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding", "label")
    width, books = codebooks(vectors, rounds)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value:
            return
        entries = [Entries(b) for b in shared.value]
        for batch, rows in _blocks(batches, width):
            told = [e.nearest(p) for e, p in zip(entries, _parts(rows), strict=True)]
            code = np.stack([c for c, _ in told], axis=1).astype(np.uint8)
            errors = [min(sum(int(d[i]) for _, d in told), MOST) for i in range(len(rows))] if any(d.dtype == object for _, d in told) else sum(d for _, d in told)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([c.tobytes().hex() for c in code]), pa.array(errors, pa.int64()), batch.column(2)], names=["vec_id", "code", "error", "label"])

    label = vectors.schema["label"].dataType.simpleString()
    coded = written(vectors.mapInArrow(run, f"vec_id long, code string, error long, label {label}"), "codes")
    # labels may be as many as rows; equal ones are added up before the shuffle
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
