"""Document quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of ``PASSAGE`` words. Each passage is described by the make-up of its
bytes and words and encoded by one layer; gated attention weighs the encodings, and the weighted sum
is scored. Only documents carry labels; which passages matter is learned, from all passages of the sampled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import ship
from folioflow.llm.kernels import LOWER, NOT_SPACE, buffers, chunks, release, span_hash, spans
from folioflow.llm.learn import MAX_ROWS, held_out, labelled_sample, sigmoid

PASSAGE, HIDDEN, GATE = 48, 24, 12
HASHED = 16
#: Passages of a training batch.
AT_ONCE = 8192
#: Of the sample, good and bad.
SHARES = {1: 0.6, 0: 0.4}

#: Byte classes that are counted: everything else is 0, then lower case, capitals, digits, and single marks.
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x80:] = 4
for _k, _c in enumerate(b"!*#$%&|.,-/@_=<>", 5):
    _CLASS[_c] = _k
CLASSES = int(_CLASS.max()) + 1
FEATURES = CLASSES + 8 + HASHED


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, FEATURES) of every passage, and the offsets of each text's passages; a text without words has none."""
    starts, ends, woff = spans(data, off, NOT_SPACE)
    n_words = np.diff(woff)
    n_pass = -(-n_words // PASSAGE)
    poff = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(poff[-1])
    if not total:
        return np.zeros((0, FEATURES), np.float32), poff
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(starts)) - woff[doc]
    pid = poff[doc] + place // PASSAGE
    size = np.bincount(pid, minlength=total).astype(np.float32)
    h = span_hash(LOWER[data], starts, ends)
    length = ends - starts
    byte_pid = np.repeat(pid, length)
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    classes = np.bincount(byte_pid * CLASSES + _CLASS[data[inside]], minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float32)
    n_bytes = classes.sum(axis=1, keepdims=True)
    x = np.zeros((total, FEATURES), np.float32)
    x[:, :CLASSES] = classes / n_bytes
    for k, lag in enumerate((1, 2, 3, 31)):  # words that come again
        same = np.zeros(len(h), bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (place[lag:] >= lag)
        x[:, CLASSES + k] = np.bincount(pid, same, total) / size
    pairs = np.unique(pid.astype(np.uint64) << np.uint64(40) ^ h >> np.uint64(24))
    x[:, CLASSES + 4] = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=total)[:total] / size
    x[:, CLASSES + 5] = n_bytes[:, 0] / size / 8
    x[:, CLASSES + 6] = np.log1p(size) / np.log(PASSAGE + 1)
    x[:, CLASSES + 7] = np.bincount(pid, _CLASS[data[starts]] == 2, total) / size
    signs = 1 - 2 * ((h >> np.uint64(20)) & np.uint64(1)).astype(np.float32)
    lane = (h >> np.uint64(32)).astype(np.int64) % HASHED
    x[:, CLASSES + 8 :] = (np.bincount(pid * HASHED + lane, signs, total * HASHED).reshape(total, HASHED) / np.sqrt(size)[:, None]) * 0.3
    return x, poff


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    empty: float

    def forward(self, x: np.ndarray, poff: np.ndarray) -> dict[str, np.ndarray]:
        """Encodings, attention and logits of bags with at least one passage each."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        a = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(poff) - 1), np.diff(poff))
        a = np.exp(a - np.maximum.reduceat(a, poff[:-1])[bag])
        a = a / np.add.reduceat(a, poff[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, poff[:-1], axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "logit": z @ p["c"] + p["d"][0]}

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, poff = passages(data, off)
        out = np.full(len(off) - 1, self.empty)
        full = np.flatnonzero(np.diff(poff) > 0)
        if len(full):
            got = self.forward((x - self.mean) / self.scale, np.append(poff[:-1][full], poff[-1]))
            out[full] = sigmoid(got["logit"])
        return out


def train(texts: pa.Array, labels: list[int], prior: float, epochs: int = 60, batch: int = 256, seed: int = 9) -> Model:
    """Fits by Adam on the log loss, rows weighted back to the share ``prior`` of label 1."""
    rng = np.random.default_rng(seed)
    new = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": new(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": new(HIDDEN, GATE), "U": new(HIDDEN, GATE), "w": new(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    y = np.array(labels, np.float64)
    model = Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), p, prior)
    p["d"][0] = np.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return model
    parts = [passages(*buffers(texts.slice(i, 100))) for i in range(0, len(texts), 100)]
    x = np.concatenate([a for a, _ in parts])
    counts = np.concatenate([np.diff(b) for _, b in parts])
    poff = np.concatenate([[0], np.cumsum(counts)])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - model.mean) / model.scale
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    rows = np.flatnonzero(counts > 0)
    m, v, step = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
    for epoch in range(epochs):
        rng.shuffle(rows)
        upto = np.cumsum(counts[rows])
        i = 0
        while i < len(rows):
            # whole bags, all their passages; a bag of more than AT_ONCE passages is a batch of its own
            j = max(i + 1, min(i + batch, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, "right"))))
            some, i = rows[i:j], j
            size = counts[some]
            off = np.concatenate([[0], np.cumsum(size)])
            part = np.repeat(poff[some] - off[:-1], size) + np.arange(int(off[-1]))
            xb = x[part]
            f = model.forward(xb, off)
            bag = f["bag"]
            g = weight[some] * (sigmoid(f["logit"]) - y[some]) / len(some)
            gz = g[:, None] * p["c"]
            grads = {"c": f["z"].T @ g, "d": np.array([g.sum()])}
            gh = f["a"][:, None] * gz[bag]
            ga = (f["h"] * gz[bag]).sum(axis=1)
            ga = f["a"] * (ga - np.add.reduceat(f["a"] * ga, off[:-1])[bag])
            grads["w"] = (f["t"] * f["s"]).T @ ga
            gt = ga[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
            gs = ga[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
            grads["V"], grads["U"] = f["h"].T @ gt, f["h"].T @ gs
            gh = (gh + gt @ p["V"].T + gs @ p["U"].T) * (1 - f["h"] ** 2)
            grads["W"], grads["b"] = xb.T @ gh + 1e-4 * p["W"], gh.sum(axis=0)
            step += 1
            rate = 0.01 * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
            for k, gk in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.p = {k: a.astype(np.float32) for k, a in p.items()}
    return model


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold; the prior is counted over all such labels."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    prior = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    texts, y = labelled_sample(docs, labels, "quality", SHARES, max_rows)
    return train(texts, y, float(np.clip(0.5 if prior is None else prior, 0.01, 0.99)))


def assess(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: held_out, score (likelihood of quality 1), predicted (score >= cut).

    The score depends on the text alone; null and empty texts and texts without words score the share of
    good labels.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, max_rows))
    release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, off in chunks(batches, "text"):
            score = model.score(data, off).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
