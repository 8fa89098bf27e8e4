"""Best-fit packing of token pieces into sequences under three capacities: tokens, documents and attention cost.

A piece's length decides everything about it, so bins are chosen for lengths, not for pieces: the
histogram of lengths (as many numbers as a sequence has tokens, whatever the input) is packed on the
driver by vector best fit, in runs of like bins, and the plan's runs (a few per length) are joined
back to the pieces by their rank among those of the same length. No task sees more than its share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.bpe import LONGEST, Merger
from folioflow.llm.common import ranked, ship, written
from folioflow.llm.kernels import NOT_SPACE, chunks, release, span_hash, spans

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Slots for units whose ids are kept in a worker, and how many ids are kept before the store starts anew.
STORE_BITS, STORE_IDS = 18, 1 << 21


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Kinds of bytes: white space, letters, digits, marks, and all that is left to the library.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[[0x27, 0x3C]] = 4  # an apostrophe joins letters to it; < may begin a special token
_KIND[~NOT_SPACE] = 0


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with simple letters in lower case; starts, ends and kinds of the units; and the n + 1 offsets of each text's units.

    In words of ASCII and Latin-1 letters a unit is a run of letters, one digit or a run of marks, as the tokenizer's pattern
    has it; any other word is one unit of kind 4.
    """
    kind = _KIND[data]
    if len(data) > 1:
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kind[:-1][pair] = 1
        kind[1:][pair] = 1
    starts, ends, _ = spans(data, off, NOT_SPACE)
    odd = np.flatnonzero(kind == 4)
    if len(odd):  # the whole word is left to the library
        word = np.unique(np.searchsorted(starts, odd, "right") - 1)
        mark = np.zeros(len(data) + 1, np.int32)
        np.add.at(mark, starts[word], 1)
        np.add.at(mark, ends[word], -1)
        kind[np.cumsum(mark[:-1]) > 0] = 4
    low = data.copy()
    letter = kind == 1
    low[letter & (data >= 0x41) & (data <= 0x5A)] += 32
    if len(data) > 1:
        low[1:][letter[1:] & (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge[off] = True
    at = np.flatnonzero(edge[:-1])
    to = np.append(at[1:], len(data))
    full = kind[at] > 0 if len(data) else np.zeros(0, bool)
    at, to = at[full], to[full]
    return low, at, to, kind[at], np.searchsorted(at, off)


class Encoder:
    """Token ids of whole texts, worked out once for each distinct unit that a chunk has and the store lacks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its units one after the other.
    """

    def __init__(self, path: str, merger: Merger | None = None) -> None:
        self.path, self.merger, self._tokenizer = path, merger or Merger(path), None
        self.keys = np.zeros(1 << STORE_BITS, np.uint64)
        self.start, self.size = np.zeros(1 << STORE_BITS, np.int64), np.zeros(1 << STORE_BITS, np.int64)
        self.pool, self.used = np.zeros(STORE_IDS, np.uint32), 0

    @property
    def tokenizer(self):
        """The library's tokenizer, read when the first unit needs it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def _learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """(start in the pool, size) of the ids of new units, and whether the store was emptied for them."""
        ids, sizes = np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        short = (kinds < 4) & (ends - starts <= LONGEST)
        a, b = np.flatnonzero(short), np.flatnonzero(~short)
        merged, sizes[a] = self.merger.ids(low, starts[a], (ends - starts)[a])
        raw = low.tobytes()
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([raw[x:y].decode() for x, y in zip(starts[b], ends[b], strict=True)], add_special_tokens=False)] if len(b) else []
        sizes[b] = [len(x) for x in rest]
        ids = np.concatenate([merged, *(np.array(x, np.uint32) for x in rest)])
        order = np.concatenate([a, b])
        emptied = self.used + len(ids) > len(self.pool)
        if emptied:
            self.keys[:] = 0
            self.used = 0
            if len(ids) > len(self.pool):
                self.pool = np.zeros(2 * len(ids), np.uint32)
        self.pool[self.used : self.used + len(ids)] = ids
        at = np.zeros(len(starts), np.int64)
        at[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self.used += len(ids)
        return at, sizes, emptied

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, each text followed by id 0; and the n + 1 offsets."""
        low, starts, ends, kinds, uoff = units(data, off)
        h = span_hash(low, starts, ends)
        slot = (h >> np.uint64(64 - STORE_BITS)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != h)
        if len(new):
            _, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            some = new[first]
            at, sizes, emptied = self._learn(low, starts[some], ends[some], kinds[some])
            if emptied and len(new) < len(h):  # gone too is what this chunk had found there, so now all of it is new
                some = np.unique(h, return_index=True)[1]
                new, inverse = np.arange(len(h)), np.unique(h, return_inverse=True)[1]
                self.used = 0
                at, sizes, _ = self._learn(low, starts[some], ends[some], kinds[some])
            start, size = self.start[slot], self.size[slot]
            start[new], size[new] = at[inverse], sizes[inverse]
            self.keys[slot[some]], self.start[slot[some]], self.size[slot[some]] = h[some], at, sizes
        else:
            start, size = self.start[slot], self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        n = len(off) - 1
        ends_at = total[uoff]  # in ids without terminators
        ids = np.zeros(int(total[-1]) + n, np.uint32)
        real = np.ones(len(ids), bool)
        real[ends_at[1:] + np.arange(n)] = False
        ids[real] = self.pool[np.repeat(start - total[:-1], size) + np.arange(int(total[-1]))]
        return ids, ends_at + np.arange(n + 1)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32; a null or empty text is the terminator alone.

    The merges, some megabytes of arrays, are read once and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merger(path))
    release()  # what reading the file took

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, shared.value)
        for batch, data, off in chunks(batches, "text"):
            ids, ioff = encoder.encode(data, off)
            raw = memoryview(ids.astype("<u4").tobytes())
            n = -(-np.diff(ioff) // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(ioff)[doc] - start)
            at = (ioff[doc] + start) * 4
            crc = [crc32(raw[a : a + b]) for a, b in zip(at.tolist(), (4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bins:
    """``count`` like bins, numbered from ``first``: used tokens, documents and attention cost of each."""

    first: int
    count: int
    tokens: int
    docs: int
    cost: int


def plan(histogram: dict[int, int], capacity: int, max_docs: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.02, 0.02)) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank from, rank to, first sequence, pieces a sequence, offset) that place every piece.

    Lengths go from the longest. A piece takes that bin, of those that hold it under every capacity,
    which scores best: ``norm``, the least weighted norm of what is left after it; ``dot``, the greatest
    weighted product of its needs and what is left before. All needs and rests count as shares of
    their capacity. Like bins are taken together, so the plan grows with the lengths, not the pieces.
    """
    full = (capacity, max_docs, max_cost)
    states: dict[tuple[int, int, int], list[list[int]]] = {}  # used amounts: runs [first bin, bins]
    runs, fresh = [], 0

    def score(used: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        rest = [(f - u) / f for f, u in zip(full, used, strict=True)]
        share = [n / f for f, n in zip(full, need, strict=True)]
        if rule == "dot":
            return -sum(w * r * s for w, r, s in zip(weights, rest, share, strict=True))
        return sum(w * (r - s) ** 2 for w, r, s in zip(weights, rest, share, strict=True))

    for length in sorted(histogram, reverse=True):
        need, left, rank = (length, 1, length * length), histogram[length], 0
        if any(n > f for n, f in zip(need, full, strict=True)):
            raise ValueError(f"a piece of {length} tokens passes a capacity")
        while left:
            fits = [u for u in states if all(a + b <= f for a, b, f in zip(u, need, full, strict=True))]
            used = min(fits, key=lambda u: (score(u, need), u)) if fits else (0, 0, 0)
            most = min((f - u) // n for f, u, n in zip(full, used, need, strict=True))
            if fits:
                first, count = states[used].pop()
                if not states[used]:
                    del states[used]
            else:
                first, count = fresh, -(-left // most)
                fresh += count
            each = most if rule == "norm" or not fits else 1
            each = min(each, left)
            take = min(count, left // each)
            runs.append((length, rank, rank + take * each, first, each, used[0]))
            rank, left = rank + take * each, left - take * each
            now = tuple(u + each * n for u, n in zip(used, need, strict=True))
            if now[0] < capacity:
                states.setdefault(now, []).append([first, take])
            if take < count:  # bins of this run that are still as they were, or, of new ones, not there yet
                states.setdefault(used, []).append([first + take, count - take])
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """Pieces with sequence_id and offset. Without other limits documents and attention cost bind no earlier than tokens do, but still weigh in the choice.

    A full piece is a sequence of its own. An empty table gives no rows; like pieces take each other's place freely.
    """
    spark = parts.sparkSession
    counts = {int(r.length): int(r.n) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(counts, capacity, max_docs or capacity, max_cost or capacity * capacity, rule)
    schema = "length long, low long, high long, first long, each long, base long"
    table = spark.createDataFrame([tuple(map(int, r)) for r in runs], schema)
    placed = ranked(parts, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "_rank")
    # a few runs for each length; each piece lies in one
    by_length = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "each", "base"))).alias("_runs"))
    out = placed.join(F.broadcast(by_length), "length").withColumn("_run", F.expr("filter(_runs, r -> r.low <= _rank and _rank < r.high)[0]"))
    i = F.col("_rank") - F.col("_run.low")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run.first") + F.floor(i / F.col("_run.each"))).alias("sequence_id"),
        (F.col("_run.base") + (i % F.col("_run.each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs the ids of whole texts, each followed by id 0; longer ones are cut into pieces of ``capacity``."""
    ship(docs.sparkSession)
    parts = written(pieces(docs, path or tokenizer_path(), capacity), "pieces")
    return pack(parts, capacity)
