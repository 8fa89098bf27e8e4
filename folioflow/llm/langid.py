"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are the 3 and 4 bytes from every place of the lower-cased text, with whatever is not a
letter as one blank, hashed to ``BUCKETS``. As the embeddings are averaged and the layer is linear,
each bucket's logits are worked out once, and a text's logits are the mean over its places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import ship
from folioflow.llm.kernels import LOWER, buffers, chunks, release
from folioflow.llm.learn import MAX_ROWS, PIECES, Adagrad, column_sample, held_out, merged, pieces, temperature

BUCKETS, DIM = 1 << 15, 16
_rng = np.random.default_rng(7)
_Z = _rng.integers(0, 1 << 32, (4, 256), dtype=np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def subwords(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two bucket numbers for every byte; bucket 0 where the text ends before the subword does, or nothing but blanks is there."""
    x = LOWER[data]
    if len(x) > 1:  # capital letters of Latin-1, in UTF-8
        capital = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
        x[1:][capital] += 0x20
    x = np.where(_LETTER[x], x, np.uint8(0x20))
    n = len(x)
    out = np.zeros((2, n), np.uint32)
    h = np.zeros(n, np.uint32)
    for k in range(4):
        h[: n - k] ^= _Z[k][x[k:]]
        if k >= 2:
            g = h * np.uint32(0x9E3779B1)
            out[k - 2] = 1 + (g >> np.uint32(7)) % np.uint32(BUCKETS - 1)
            ends = off[1:, None] - 1 - np.arange(k)
            ends = ends[(ends >= off[:-1, None]) & (ends >= 0)]
            out[k - 2][ends] = 0
    out[:, x == 0x20] = 0
    return out


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float
    reject: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The calibrated probabilities (texts, languages)."""
        n = len(off) - 1
        sums = np.zeros((n, len(self.langs)))
        size = np.ones(n)
        if len(data):
            sub = subwords(data, off)
            full = np.flatnonzero(np.diff(off) > 0)
            at = off[:-1][full]
            count = np.zeros(n)
            for k in range(2):
                sums[full] += np.add.reduceat(self.logits[sub[k]], at, axis=0)
                count[full] += np.add.reduceat((sub[k] > 0).astype(np.int64), at)
            size = np.maximum(count, 1)
        z = (sums / size[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    data, off = buffers(texts)
    bags = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        sub = subwords(data[a:b], np.array([0, b - a])).ravel()
        ids, counts = np.unique(sub[sub > 0], return_counts=True)
        bags.append((ids.astype(np.int64), (counts / max(1, counts.sum())).astype(np.float32)))
    return bags


def train(texts: pa.Array, labels: list[str], epochs: int = 4, batch: int = 32, seed: int = 1) -> Model:
    """A model of the labels' languages; a fifth of the texts calibrates temperature and rejection."""
    langs = sorted(set(labels))
    if len(langs) < 2:
        return Model(langs, np.zeros((BUCKETS, max(1, len(langs))), np.float32), np.zeros(max(1, len(langs)), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    bags = _bags(texts)
    order = rng.permutation(len(y))
    cal, fit = order[: len(y) // 5], order[len(y) // 5 :]
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    b = np.zeros(len(langs), np.float32)
    opt = Adagrad(0.2)
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            rows = fit[i : i + batch]
            ids, inverse = np.unique(np.concatenate([bags[r][0] for r in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(ids)), np.float32)
            x[np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows]), inverse] = np.concatenate([bags[r][1] for r in rows])
            v = x @ e[ids]
            z = v @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            gv = p @ w.T
            opt.step("w", w, v.T @ p)
            opt.step("b", b, p.sum(axis=0))
            opt.step("e", e, x.T @ gv, ids)
    logits = e @ w
    logits[0] = 0
    z = np.array([(f[:, None] * logits[i]).sum(axis=0) + b if len(i) else b for i, f in (bags[r] for r in cal)]) if len(cal) else np.zeros((0, len(langs)))
    t = temperature(z, y[cal]) if len(cal) else 1.0
    model = Model(langs, logits.astype(np.float32), b, t, 0.0)
    if len(cal):
        s = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        top = (s.max(axis=1) / s.sum(axis=1))[z.argmax(axis=1) == y[cal]]
        model.reject = float(np.quantile(top, 0.01)) if len(top) else 0.0
    return model


#: Languages whose counts a task holds before it sends them.
LANGS_HELD = 64


def counted(docs: DataFrame) -> Model:
    """A model of the subword counts of every text outside the held-out fold whose lang is not null: the mean log-likelihood, equal ones by how common a language is.

    Counts are summed by tasks; the driver gets one vector of ``BUCKETS`` numbers for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch, data, off in chunks(batches, "text"):
            sub = subwords(data, off)
            coded = batch.column(1).dictionary_encode()
            of = np.repeat(coded.indices.to_numpy(), np.diff(off))
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                held = sums.setdefault((lang, 0), np.zeros(BUCKETS, np.int64))
                held += np.bincount(sub[:, of == k].ravel(), minlength=BUCKETS)
            if len(sums) >= LANGS_HELD:
                yield from pieces(sums)
                sums = {}
        yield from pieces(sums)

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("text", F.col("lang").cast("string").alias("lang"))
    counts = {lang: v for (lang, _), v in merged(rows.mapInArrow(run, PIECES), "int64").items()}
    langs = sorted(counts)
    if len(langs) < 2:
        return Model(langs, np.zeros((BUCKETS, max(1, len(langs))), np.float32), np.zeros(max(1, len(langs)), np.float32), 1.0, 0.0)
    logits, sizes = np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        n = counts[lang].astype(float)
        n[0] = 0
        sizes[k] = n.sum() + 1
        logits[1:, k] = np.log((n[1:] + 0.5) / (n.sum() + 0.5 * (BUCKETS - 1)))
    return Model(langs, logits, (1e-6 * np.log(sizes / sizes.sum())).astype(np.float32), 1.0, 0.0)


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: held_out, lang_pred, score and accepted.

    ``score`` is the calibrated probability of ``lang_pred``; ``accepted`` is false below the rejection
    threshold, under which one in a hundred right predictions of the calibration texts lies. A null
    text, one without a letter, and every text where no language was learned: ``und``, 0, not accepted.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(*column_sample(docs, "lang", max_rows)))
    release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, off in chunks(batches, "text"):
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if model.langs:
                p = model.scores(data, off)
                best = p.argmax(axis=1)
                score = np.where(letters, p[np.arange(len(best)), best], 0.0)
                pred = [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
            else:
                score, pred = np.zeros(batch.num_rows), ["und"] * batch.num_rows
            accepted = (score >= model.reject) & letters & bool(model.langs)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted)], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
