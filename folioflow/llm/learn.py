"""Bounded, documented training samples, the held-out fold, and small numpy helpers of the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import fetched, tidied

#: Rows of a training sample at most (about; they are drawn by a hash of doc_id). The documented bound of every classifier here.
MAX_ROWS = 8000
#: Bytes of text that are collected for training at most; documents beyond are left out, never cut.
MAX_BYTES = 64 << 20

#: Parts in which a share of the rows is drawn by the first of two hashes.
SCALE = 1_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learned from: crc32 of doc_id as text, mod 5, is 0. A null id counts as empty text, so held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _drawn(rows: DataFrame, label: str, shares: dict | None, max_rows: int) -> DataFrame:
    """About ``max_rows`` of the rows, drawn by a hash of doc_id; ``shares`` of them by label, or as many of each, however many labels there are."""
    counts = rows.groupBy(label).count()
    if shares:
        share = F.lit(0.0)
        for value, part in shares.items():
            share = F.when(F.col(label) == value, float(part)).otherwise(share)
    else:
        share = F.lit(1 / max(1, counts.count()))
    part = F.least(F.lit(1.0), share * max_rows / F.col("count")) * SCALE
    bound = F.when(share > 0, F.greatest(F.lit(1), F.floor(part))).otherwise(0)
    # a share below one in ``SCALE`` is drawn again by a second hash, so that the sample is as small however many rows there are
    fine = F.floor(F.least(F.lit(1.0), part) * float(1 << 53))
    bounds = counts.select(label, bound.alias("_bound"), fine.alias("_fine"))  # a row for each label
    first = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(SCALE)) < F.col("_bound")
    second = F.shiftrightunsigned(F.xxhash64(F.lit("second"), F.col("doc_id")), 11) < F.col("_fine")
    return rows.join(F.broadcast(bounds), label).where(first & second).select(*rows.columns)


def _collected(docs: DataFrame, drawn: DataFrame) -> tuple[pa.Array, list]:
    """Texts and labels of the drawn rows (doc_id, text, label) of docs, ordered by doc_id so that training is the same each time; one of each text.

    Sizes come to the driver first, and then only texts that fit into ``MAX_BYTES``. Where the drawn texts pass it, each label has an equal share
    of it, taken in the order of a hash of doc_id, and what labels leave of theirs goes to the rest in that order.
    """
    texts_hash = F.xxhash64("text").alias("text_hash")
    known = drawn.where(F.col("text").isNotNull()).select("doc_id", "label", texts_hash, F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("hash")).distinct().toArrow()
    known = known.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text_hash", "ascending")])
    ids, labels, texts, sizes, hashes = (known[c].to_pylist() for c in ("doc_id", "label", "text_hash", "size", "hash"))
    first = sorted({t: i for i, t in reversed(list(enumerate(texts)))}.values(), key=lambda i: (hashes[i], i))
    kept, size, by_label = set(), 0, {}
    part = MAX_BYTES // max(1, len(set(labels)))
    for i in first:
        if by_label.get(labels[i], 0) + sizes[i] <= part:
            by_label[labels[i]] = by_label.get(labels[i], 0) + sizes[i]
            size += sizes[i]
            kept.add(i)
    for i in first:
        if i not in kept and size + sizes[i] <= MAX_BYTES:
            size += sizes[i]
            kept.add(i)
    at = sorted(kept)
    if not at:
        return pa.array([], pa.string()), []
    id_type = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(ids[i], texts[i]) for i in at], f"doc_id {id_type}, text_hash long")
    # copies of a kept row come once
    found = docs.select("doc_id", "text", texts_hash).join(F.broadcast(wanted), ["doc_id", "text_hash"]).select("text_hash", "text").distinct().toArrow()
    by_hash = dict(zip(found["text_hash"].to_pylist(), range(len(found)), strict=True))
    at = [i for i in at if texts[i] in by_hash]
    tidied(docs.sparkSession)  # of what was sent here, before training takes memory
    return found["text"].combine_chunks().take(pa.array([by_hash[texts[i]] for i in at], pa.int64())), [labels[i] for i in at]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, shares: dict | None = None, max_rows: int = MAX_ROWS) -> tuple[pa.Array, list]:
    """Texts and labels of a bounded sample of the labelled documents outside the held-out fold.

    Only labels are counted and drawn from; the drawn ids, ``max_rows`` or so, are sent to the scan of documents.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = _drawn(known, "label", shares, max_rows).groupBy("doc_id").agg(F.min("label").alias("label"))
    return _collected(docs, docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))


def column_sample(docs: DataFrame, label: str, max_rows: int = MAX_ROWS) -> tuple[pa.Array, list]:
    """As labelled_sample, for a label that is a column of documents itself."""
    known = docs.select("doc_id", "text", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return _collected(docs, _drawn(known, "label", None, max_rows))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, values: list) -> DataFrame:
    """(doc_id, text, label) of every document outside the held-out fold that has a text and one of these values; the least where a doc_id has several."""
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isin(values) & F.col("doc_id").isNotNull() & ~held_out())
    return fetched(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), known.groupBy("doc_id").agg(F.min("label").alias("label")))


#: What tasks send to merged(): a piece of a vector under its key and number; ``task`` only orders it.
PIECES = "key string, part int, task int, vector binary"


def pieces(vectors: dict[tuple[str, int], np.ndarray], task: int = 0) -> Iterator[pa.RecordBatch]:
    """A row of each vector that is not all zero."""
    for (key, part), v in vectors.items():
        if v.any():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["key", "part", "task", "vector"])


def merged(rows: DataFrame, dtype: str, mean: bool = False) -> dict[tuple[str, int], np.ndarray]:
    """The sum of the vectors (PIECES) of each key and part, added up by tasks in the order of ``task``; or each component's mean over those vectors where it is not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, count = None, None, None
        for batch in batches:
            for key, part, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                v = np.frombuffer(vector.as_buffer(), dtype)
                if at != (key, part):
                    if at is not None:
                        yield from pieces({at: (total / np.maximum(count, 1) if mean else total).astype(dtype)})
                    at, total, count = (key, part), np.zeros(len(v), np.float64 if mean else dtype), np.zeros(len(v), np.int32)
                total += v
                count += v != 0
        if at is not None:
            yield from pieces({at: (total / np.maximum(count, 1) if mean else total).astype(dtype)})

    found = rows.repartition("key", "part").sortWithinPartitions("key", "part", "task").mapInArrow(run, PIECES).toArrow()
    return {(k, p): np.frombuffer(v.as_buffer(), dtype) for k, p, v in zip(found["key"].to_pylist(), found["part"].to_pylist(), found["vector"], strict=True)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adagrad:
    """Per-weight step sizes; dense arrays, or the given rows of one."""

    def __init__(self, rate: float) -> None:
        self.rate, self.sums = rate, {}

    def step(self, name: str, w: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        s = self.sums.setdefault(name, np.full(w.shape, 1e-6, w.dtype))
        if rows is None:
            s += g * g
            w -= self.rate * g / np.sqrt(s)
        else:
            s[rows] += g * g
            w[rows] -= self.rate * g / np.sqrt(s[rows])


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits (n, classes) that makes the labels y likeliest."""
    best, at = np.inf, 1.0
    for t in np.geomspace(0.2, 8, 40):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))
        if loss < best:
            best, at = loss, float(t)
    return at
