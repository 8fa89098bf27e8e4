"""How common tokens are in the whole corpus: exact counts of hashed buckets, summed over all tasks.

Each task counts its tokens in a table of fixed size and hands it on in packed slices; slices are
summed as they stream in, and what reaches the driver has the table's size, whatever the corpus has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tokens are counted in 2 ** HOT_BITS buckets, and the counts travel in so many slices.
HOT_BITS, SLICES = 20, 64
MASK = np.uint64((1 << HOT_BITS) - 1)
#: A bucket is common where the corpus puts this many tokens into it above what chance gives.
HOT_LEAST, HOT_SIGMAS = 16, 6


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens & MASK).astype(np.int64)


class Tally:
    """A task's counts of tokens, by bucket."""

    def __init__(self) -> None:
        self.total, self.parts, self.size = np.zeros(1 << HOT_BITS, np.uint32), [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.parts.append((tokens & MASK).astype(np.int32))
        self.size += len(tokens)
        if self.size >= 1 << HOT_BITS:
            self._count()

    def _count(self) -> None:
        if self.parts:
            self.total += np.bincount(np.concatenate(self.parts), minlength=1 << HOT_BITS).astype(np.uint32)
        self.parts, self.size = [], 0

    def slices(self) -> tuple[np.ndarray, list[bytes]]:
        """The slices of the counts that are not all zero: their numbers and packed bytes."""
        self._count()
        parts = self.total.reshape(SLICES, -1)
        full = np.flatnonzero(parts.any(axis=1))
        return full.astype(np.int32), [zlib.compress(parts[i].tobytes(), 1) for i in full]


def bucket_loads(slices: DataFrame) -> np.ndarray:
    """The sums of all tasks' slices (``slice``, ``loads``), as one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32)
                sums[i] = sums[i] + part if i in sums else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "loads"])

    tasks = min(SLICES, int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((SLICES, (1 << HOT_BITS) // SLICES), np.int64)
    for r in slices.select("slice", "loads").repartition(tasks, "slice").mapInArrow(run, "slice int, loads binary").collect():
        out[r.slice] = np.frombuffer(r.loads, np.int64)
    return out.reshape(-1)


def common_from(loads: np.ndarray) -> float:
    """The count from which a bucket holds a common token."""
    mean = loads.mean()
    return float(mean + HOT_SIGMAS * np.sqrt(mean) + HOT_LEAST)
