"""Toxicity: a convolutional text classifier over hashed word embeddings, trained by numpy in tasks that each take a share of all labelled rows.

A word is the sum of three hashed embeddings: two of the whole word, from different bits of its
hash, so that a single collision never makes two words alike, and one of its first four bytes.
Filters of widths 1, 2 and 3 slide over the words, and the greatest response of each filter in the
text feeds a logistic layer. The filters are linear below the maximum, so each bucket's responses
are worked out once and a text is scored by looking them up.

Every labelled row outside the held-out fold is learned from: four fifths by the network, the others by the thresholds. In each pass
over them the rows are dealt anew to shards, a task goes through a shard in small batches from where the last pass ended, and
what the tasks changed is averaged, each number over the tasks that changed it.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, ship, tidied, written
from folioflow.llm.kernels import ALNUM, LOWER, chunks, release, span_hash, spans
from folioflow.llm.langid import Model as LanguageModel
from folioflow.llm.langid import counted as count_languages
from folioflow.llm.learn import PIECES, Adagrad, held_out, labelled_rows, merged, pieces, sigmoid

BITS, DIM, WIDTHS, FILTERS = 16, 12, (1, 2, 3), 8
BUCKETS = 1 << BITS
TAPS = sum(WIDTHS)  # positions of all filters' windows
#: What share of the weight toxic rows have at least, however rare they are.
TOXIC_SHARE = 0.3
#: Passes over the rows, rows of a small batch at most, and rows from which on another shard is made; shards there are at most.
PASSES, BATCH, SHARD_ROWS, SHARDS = 5, 64, 8000, 64
#: Rows that counts by bucket are brought to where there are more, so that the start of the embeddings does not depend on how many there are.
START_ROWS = 8000
#: Numbers of the network's state that tasks send in one piece.
PIECE = 1 << 14
CUTS = np.linspace(0.05, 0.95, 19)
#: Columns of classify().
ADDED = ("held_out", "score", "predicted", "lang_told", "flagged")


def word_ids(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for every word (3, words), and the offsets of each text's words."""
    data = LOWER[data]
    starts, ends, woff = spans(data, off, ALNUM)
    h = span_hash(data, starts, ends)
    stem = span_hash(data, starts, np.minimum(ends, starts + 4))
    m = np.uint64(BUCKETS - 1)
    return np.stack([h & m, (h >> np.uint64(24)) & m, (stem >> np.uint64(48)) & m]).astype(np.int64), woff


@dataclass
class Network:
    embed: np.ndarray  # (3, BUCKETS, DIM)
    filters: np.ndarray  # (DIM, TAPS * FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS)
    out: np.ndarray
    base: float
    empty: float = 0.0  # logit of a text without words

    def tables(self) -> np.ndarray:
        return np.stack([(e @ self.filters).astype(np.float32) for e in self.embed])

    def respond(self, taps: np.ndarray, woff: np.ndarray) -> np.ndarray:
        """Every filter's response at every word, from the words' taps; -inf where the window passes the text's end."""
        n = len(taps)
        r = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        at = 0
        for k, width in enumerate(WIDTHS):
            part = r[:, k * FILTERS : (k + 1) * FILTERS]
            part[:] = taps[:, at * FILTERS : (at + 1) * FILTERS]
            for j in range(1, width):
                part[: n - j] += taps[j:, (at + j) * FILTERS : (at + j + 1) * FILTERS]
                ends = woff[1:] - j
                part[ends[ends >= woff[:-1]]] = -np.inf
            at += width
        return r

    def logits(self, ids: np.ndarray, woff: np.ndarray, tables: np.ndarray) -> np.ndarray:
        z = np.full(len(woff) - 1, self.empty)
        full = np.flatnonzero(np.diff(woff) > 0)
        if len(full):
            taps = tables[0][ids[0]]
            taps += tables[1][ids[1]]
            taps += tables[2][ids[2]]
            pooled = np.maximum.reduceat(self.respond(taps, woff), woff[:-1][full], axis=0)
            z[full] = np.maximum(pooled + self.bias, 0) @ self.out + self.base
        return z


def started(counts: np.ndarray, n: tuple[int, int], seed: int = 3) -> Network:
    """A network before training. The first coordinate of each embedding is how much oftener the bucket is in toxic texts than chance has it.

    ``counts`` (clean and toxic, 3, BUCKETS) are the texts that hold a bucket, ``n`` all clean and toxic texts.
    """
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (3, BUCKETS, DIM)).astype(np.float32)
    filters = rng.normal(0, 0.05, (DIM, TAPS * FILTERS)).astype(np.float32)
    filters[0] = np.abs(filters[0]) + 0.15
    net = Network(embed, filters, np.full(len(WIDTHS) * FILTERS, -0.5, np.float32), rng.uniform(0.05, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)
    weighted = n[1] * toxic_weight(n)
    rate = float(np.clip(weighted / (weighted + n[0]) if sum(n) else 0.1, 0.01, 0.99))
    net.empty = float(np.log(rate / (1 - rate)))
    if not min(n):
        net.base, net.out = net.empty, np.zeros_like(net.out)
        return net
    share, scale = n[1] / sum(n), min(1.0, START_ROWS / sum(n))
    total = counts.sum(axis=0) * scale
    embed[:, :, 0] = np.clip((counts[1] * scale - total * share) / np.sqrt(total * share * (1 - share) + 1), -3, 3)
    return net


def toxic_weight(n: tuple[int, int]) -> float:
    """The weight of a toxic row, where a clean one has 1."""
    return max(1.0, TOXIC_SHARE / (1 - TOXIC_SHARE) * n[0] / n[1]) if n[1] else 1.0


class Training:
    """A network and the sums of its step sizes."""

    def __init__(self, net: Network) -> None:
        self.net, self.opt = net, Adagrad(0.02)
        self.base = np.array([net.base], np.float32)
        self.parts = {"e0": net.embed[0], "e1": net.embed[1], "e2": net.embed[2], "f": net.filters, "o": net.out, "b": net.bias, "z": self.base}
        for name, w in self.parts.items():
            self.opt.sums[name] = np.full(w.shape, 1e-6, w.dtype)

    def _arrays(self) -> list[np.ndarray]:
        return [*self.parts.values(), *(self.opt.sums[name] for name in self.parts)]

    def state(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self._arrays()])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for a in self._arrays():
            a[...] = state[at : at + a.size].reshape(a.shape)
            at += a.size
        self.net.base = float(self.base[0])

    def step(self, part: np.ndarray, off: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
        """One step down the weighted mean loss of some texts, each of one word at least."""
        net, embed, filters = self.net, self.net.embed, self.net.filters
        first = np.cumsum([0, *WIDTHS])[:-1]
        taps = (embed[0][part[0]] + embed[1][part[1]] + embed[2][part[2]]) @ filters
        r = net.respond(taps, off)
        pooled = np.maximum.reduceat(r, off[:-1], axis=0)
        active = np.maximum(pooled + net.bias, 0)
        g = ((sigmoid(active @ net.out + net.base) - y) * weights / weights.sum()).astype(np.float32)
        g_active = g[:, None] * net.out * (active > 0)
        g_out, g_base, g_bias = active.T @ g, float(g.sum()), g_active.sum(axis=0)
        g_filters = np.zeros_like(filters)
        touched, pushed = [], []
        doc = np.repeat(np.arange(len(y)), np.diff(off))
        for f in range(len(WIDTHS) * FILTERS):
            k, lane = divmod(f, FILTERS)
            hit = np.flatnonzero(r[:, f] == pooled[doc, f])
            d, where = np.unique(doc[hit], return_index=True)
            hit = hit[where]
            use = g_active[d, f] != 0
            d, hit = d[use], hit[use]
            for j in range(WIDTHS[k]):
                col = (first[k] + j) * FILTERS + lane
                at = part[:, hit + j]
                e = embed[0][at[0]] + embed[1][at[1]] + embed[2][at[2]]
                g_filters[:, col] += g_active[d, f] @ e
                touched.append(at)
                pushed.append(g_active[d, f][:, None] * filters[:, col])
        at, push = np.concatenate(touched, axis=1), np.concatenate(pushed)
        for c in range(3):
            u, inv = np.unique(at[c], return_inverse=True)
            if len(u):
                gu = np.zeros((len(u), DIM), np.float32)
                np.add.at(gu, inv, push)
                self.opt.step(f"e{c}", embed[c], gu, u)
        self.opt.step("f", filters, g_filters)
        self.opt.step("o", net.out, g_out)
        self.opt.step("b", net.bias, g_bias)
        self.opt.step("z", self.base, np.array([g_base], np.float32))
        net.base = float(self.base[0])


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many clean and toxic texts of the rows (text, label) hold each bucket: (2, 3, BUCKETS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 3, BUCKETS), np.int64)
        for batch, data, off in chunks(batches, "text"):
            ids, woff = word_ids(data, off)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(woff))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in range(3):
                d, bucket = np.divmod(np.unique(doc * BUCKETS + ids[c]), BUCKETS)
                for label in range(2):
                    counts[label, c] += np.bincount(bucket[y[d] == label], minlength=BUCKETS)
        yield from pieces({("", label * 3 + c): counts[label, c] for label in range(2) for c in range(3)})

    found = np.zeros((6, BUCKETS), np.int64)
    for (_, at), v in merged(rows.select("text", "label").mapInArrow(run, PIECES), "int64").items():
        found[at] = v
    return found.reshape(2, 3, BUCKETS)


def changes(rows: DataFrame, training: Training, turn: int, shards: int, weight: float) -> dict[int, np.ndarray]:
    """What one pass over the rows changes in the state, by pieces: each shard is gone through by a task, in the order of a hash."""
    shared = rows.sparkSession.sparkContext.broadcast((training.net, training.state()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, shard = None, 0
        for batch, data, off in chunks(batches, "text"):
            if mine is None:
                net, before = shared.value
                mine, shard = Training(deepcopy(net)), batch.column(0)[0].as_py()
                mine.load(before)
            ids, woff = word_ids(data, off)
            y = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float32)
            full = np.flatnonzero(np.diff(woff) > 0)
            for some in np.array_split(full, -(-len(full) // BATCH)) if len(full) else []:
                words = np.concatenate([np.arange(woff[r], woff[r + 1]) for r in some])
                mine.step(ids[:, words], np.concatenate([[0], np.cumsum(np.diff(woff)[some])]), y[some], np.where(y[some] > 0, weight, 1.0))
        if mine is not None:
            change = mine.state() - before
            yield from pieces({("", i // PIECE): change[i : i + PIECE] for i in range(0, len(change), PIECE)}, shard)
            release()

    shard, order = (F.xxhash64(F.lit(name), F.lit(turn), "doc_id") for name in ("shard", "order"))
    dealt = rows.select(F.pmod(shard, F.lit(shards)).cast("int").alias("shard"), "text", "label", order.alias("order"), "doc_id")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("order", "doc_id", "text", "label").select("shard", "text", "label")
    found = {at: v for (_, at), v in merged(dealt.mapInArrow(run, PIECES), "float32", mean=True).items()}
    shared.destroy()
    return found


def trained(rows: DataFrame, n: tuple[int, int]) -> Network:
    """A network fitted to all rows (doc_id, text, label), of which ``n`` are clean and toxic. What it learns depends on the rows alone, not on how they are partitioned."""
    if not min(n):
        return started(np.zeros((2, 3, BUCKETS), np.int64), n)
    training = Training(started(bucket_counts(rows), n))
    for turn in range(PASSES):
        state = training.state()
        for at, v in changes(rows, training, turn, min(SHARDS, -(-sum(n) // SHARD_ROWS)), toxic_weight(n)).items():
            state[at * PIECE : at * PIECE + len(v)] += v
        training.load(state)
        tidied(rows.sparkSession)  # of the rows that the pass dealt
    return training.net


def cuts_of(counts: dict[str, np.ndarray], default: float = 0.5) -> dict[str, float]:
    """Per language the score that makes the best F1, from how many clean and toxic texts reach how many of the CUTS: (2, len(CUTS) + 1); ``default`` where a label has under 20."""
    found = {}
    for lang, by_label in sorted(counts.items()):
        size = by_label.sum(axis=1)
        if size.min() < 20:
            found[lang] = default
            continue
        reach = by_label[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        f1 = 2 * reach[1] / np.maximum(1, reach.sum(axis=0) + size[1])
        best = CUTS[f1 >= f1.max() - 1e-9]
        found[lang] = float(best[np.abs(best - default).argmin()])
    return found


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str], default: float = 0.5) -> dict[str, float]:
    """Per language the score that makes the best F1 on these labelled texts; ``default`` where a language has under 20 of a label."""
    counts = {lang: np.zeros((2, len(CUTS) + 1), np.int64) for lang in langs}
    for lang, label, reached in zip(langs, labels, np.searchsorted(CUTS, scores, "right"), strict=True):
        counts[lang][label, reached] += 1
    return cuts_of(counts, default)


def told_and_scored(net: Network, language: LanguageModel, tables: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    told = [language.langs[k] for k in language.scores(data, off).argmax(axis=1)] if language.langs else ["und"] * (len(off) - 1)
    return told, sigmoid(net.logits(*word_ids(data, off), tables))


def calibrated(rows: DataFrame, net: Network, language: LanguageModel) -> dict[str, float]:
    """The thresholds from all rows (text, label); the driver gets counts by language, label and cut."""
    shared = rows.sparkSession.sparkContext.broadcast((net, language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch, data, off in chunks(batches, "text"):
            tables = shared.value[0].tables() if tables is None else tables
            told, score = told_and_scored(*shared.value, tables, data, off)
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.string()), batch.column(1).cast(pa.int32()), pa.array(np.searchsorted(CUTS, score, "right"), pa.int32())], names=["lang", "label", "reached"])

    counts = {}
    for r in rows.select("text", "label").mapInArrow(run, "lang string, label int, reached int").groupBy("lang", "label", "reached").count().collect():
        counts.setdefault(r["lang"], np.zeros((2, len(CUTS) + 1), np.int64))[r["label"], r["reached"]] = r["count"]
    shared.destroy()
    return cuts_of(counts)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Network, LanguageModel, dict[str, float]]:
    """Network, language model of texts, and thresholds by the language told from the text, from all rows outside the held-out fold.

    The network learns from four fifths of the labelled rows, drawn by a hash of doc_id, and the thresholds from its scores of the others.
    """
    ship(docs.sparkSession)
    language = count_languages(docs)
    rows = written(labelled_rows(docs, labels, "toxic", [0, 1]).withColumn("calibrates", F.pmod(F.xxhash64(F.lit("calibrates"), "doc_id"), F.lit(5)) == 0), "toxicity-rows")
    tidied(docs.sparkSession)  # of the texts that the join moved
    counts = {(r.calibrates, r.label): r["count"] for r in rows.groupBy("calibrates", "label").count().collect()}
    net = trained(rows.where(~F.col("calibrates")), (counts.get((False, 0), 0), counts.get((False, 1), 0)))
    cuts = calibrated(rows.where("calibrates"), net, language) if language.langs else {}
    dropped(rows)
    tidied(docs.sparkSession)
    return net, language, cuts


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents with held_out, score, predicted, lang_told and flagged.

    ``score`` depends on the text alone. ``predicted`` is score >= 0.5; ``flagged`` compares it with the
    calibrated threshold of the language told from the text (``und``, threshold 0.5, if none is learned).
    Null and empty texts and texts without words score the toxic rows' share of the weight. Columns of
    docs with these names are replaced.
    """
    docs = docs.drop(*ADDED)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    release()
    out = docs.withColumns({"held_out": held_out(), "score": F.lit(0.0), "predicted": F.lit(0), "lang_told": F.lit(""), "flagged": F.lit(False)})
    kept = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, language, cuts = shared.value
        tables = net.tables()
        for batch, data, off in chunks(batches, "text"):
            told, score = told_and_scored(net, language, tables, data, off)
            flagged = score >= np.array([cuts.get(x, 0.5) for x in told])
            new = {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32)), "lang_told": pa.array(told, pa.string()), "flagged": pa.array(flagged)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return out.mapInArrow(run, kept)
