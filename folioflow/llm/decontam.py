"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton reads a document's words one by one and keeps the longest run of words up to here that
some item contains. A run of ``WINDOW`` words is a window of an item; an item shorter than that is a
window as a whole. Before the automaton runs, word triples that no item has are ruled out for whole
batches at once, so that it reads only stretches in which a window can lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import aside, dropped, ship, written
from folioflow.llm.kernels import ALNUM, LOWER, buffers, chunks, shingles, span_hash, spans

WINDOW = 10
#: Words of items in one automaton; the items of a larger benchmark are dealt to several, read one after the other.
MAX_WORDS = 200_000


class Automaton:
    """Suffix automaton of several word sequences, with the windows' items at its states."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int = WINDOW) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        grams: list[np.ndarray] = []
        self.short = sorted({len(w) for _, w in items if 0 < len(w) < window})
        self.gram = min([3, window, *self.short])
        seqs = [(i, w.tolist(), w) for i, w in items if len(w)]
        for _, seq, w in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
            grams.append(shingles(w, self.gram)[: max(0, len(w) - self.gram + 1)])
        self.items: dict[tuple[int, int], set] = {}
        for item, seq, _ in seqs:
            state, size, n = 0, 0, min(len(seq), window)
            for c in seq:
                state, size = self.step(state, size, c)
                if size >= n:
                    self.items.setdefault((self.up(state, n), n), set()).add(item)
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.grams & np.uint64((1 << 20) - 1)] = True

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, size + 1)

    def up(self, state: int, n: int) -> int:
        """The state of the last n words of what ``state`` stands for."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stretches(self, sh: np.ndarray, woff: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, end) of the stretches of known word runs in which a window fits; sh: shingles of ``gram`` words."""
        if not len(self.grams) or not len(sh):
            return
        maybe = np.flatnonzero(self.bits[sh & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.grams, sh[maybe]), len(self.grams) - 1)
        known = maybe[self.grams[at] == sh[maybe]]
        text = np.searchsorted(woff, known, "right") - 1
        inside = known + self.gram <= woff[text + 1]
        known, text = known[inside], text[inside]
        if not len(known):
            return
        new = np.flatnonzero(np.r_[True, (np.diff(known) != 1) | (np.diff(text) != 0)])
        ends = np.r_[new[1:], len(known)]
        least = min([self.window, *self.short]) - self.gram + 1
        for a, b in zip(new, ends, strict=True):
            if b - a >= least:
                yield int(text[a]), int(known[a]), int(known[b - 1]) + self.gram

    def read(self, words: list[int]) -> Iterator[tuple[int, int, set]]:
        """(first word, end, items) of each window that occurs."""
        state, size = 0, 0
        sizes = [*self.short, self.window]
        for end, c in enumerate(words, 1):
            state, size = self.step(state, size, c)
            for n in sizes:
                if n > size:
                    break
                found = self.items.get((self.up(state, n), n))
                if found:
                    yield end - n, end, found


def _item_words(texts: list[str]) -> list[np.ndarray]:
    data, off = buffers(pa.array(texts, pa.string()))
    data = LOWER[data]
    starts, ends, woff = spans(data, off, ALNUM)
    wh = span_hash(data, starts, ends)
    return [wh[a:b] for a, b in zip(woff[:-1], woff[1:], strict=True)]


def _automata(benchmark: DataFrame, window: int, max_words: int) -> Iterator[tuple[Automaton, bool]]:
    """An automaton of each part of the items, and whether it is the last. Parts are told by a hash, so that each has about ``max_words`` words whatever the table has."""
    rough = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(rough) // (4 * max_words)
    for k in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).select(F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates().collect()
        texts = _item_words([r.text or "" for r in rows])
        yield Automaton([(r.item_id, w) for r, w in zip(rows, texts, strict=True)], window), k == parts - 1


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Documents, with all their columns, and ``n_words`` long, ``hits`` array of (start, end) word spans, ``items`` array of item ids, as strings.

    Words are runs of letters and digits, A-Z in lower case, other scripts as they are. Null and empty
    texts have no words; an item without words has no windows; an item without an id marks words but
    is not listed. Columns of docs with these names are replaced. ``then`` is applied to each batch after the last automaton, in the same
    task, so that a text goes to one Python worker only.
    """
    docs = docs.drop("n_words", "hits", "items")
    spark = docs.sparkSession
    ship(spark)
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.expr("cast(array() as array<struct<start:int,end:int>>)"), "items": F.expr("cast(array() as array<string>)")})
    kept = out.schema
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    stored = None
    for k, (automaton, last) in enumerate(_automata(benchmark, window, max_words)):
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, finish=then if last else None) -> Iterator[pa.RecordBatch]:
            sam = shared.value
            for batch, data, off in chunks(batches, "text"):
                data = LOWER[data]
                starts, ends, woff = spans(data, off, ALNUM)
                wh = span_hash(data, starts, ends)
                names = batch.schema.names
                hits, items = batch.column(names.index("hits")).to_pylist(), batch.column(names.index("items")).to_pylist()
                for text, a, b in sam.stretches(shingles(wh, sam.gram), woff):
                    for first, end, found in sam.read(wh[a:b].tolist()):
                        at = a - int(woff[text])
                        hits[text].append({"start": at + first, "end": at + end})
                        items[text] += found
                columns = {"n_words": pa.array(np.diff(woff), pa.int64()), "hits": pa.array([_merged(h) if len(h) > 1 else h for h in hits], hit_type), "items": pa.array([sorted(set(i) - {None}) for i in items], pa.list_(pa.string()))}
                told = pa.RecordBatch.from_arrays([columns.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)
                yield finish(told) if finish else told

        out = out.mapInArrow(run, kept)
        if k % 4 == 3 and not last:
            out = written(out, "decontamination")
            if stored is not None:
                dropped(stored)
            stored = out
    return out


def _merged(hits: list[dict]) -> list[dict]:
    out: list[dict] = []
    for h in sorted(hits, key=lambda x: x["start"]):
        if out and h["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], h["end"])
        else:
            out.append(dict(h))
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.8) -> DataFrame:
    """Documents without the spans that benchmark items cover; those covered beyond ``max_coverage`` of their words go.

    Clean rows are kept as they are. Where a span is cut, n_chars (if the column is there) is counted anew.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        hits = batch.column(names.index("hits")).to_pylist()
        if not any(hits):
            return batch
        at, words = names.index("text"), batch.column(names.index("n_words")).to_pylist()
        texts, keep = batch.column(at).to_pylist(), np.ones(len(hits), bool)
        for i, h in enumerate(hits):
            if h:
                keep[i] = sum(x["end"] - x["start"] for x in h) <= max_coverage * words[i]
                raw = (texts[i] or "").encode()
                starts, ends, _ = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
                parts, last = [], 0
                for x in h:
                    parts.append(raw[last : starts[x["start"]]])
                    last = ends[x["end"] - 1]
                texts[i] = (b"".join(parts) + raw[last:]).decode()
        return batch.set_column(at, names[at], pa.array(texts, pa.string())).filter(pa.array(keep))

    docs, back = aside(docs, ("n_words", "hits", "items"))
    found = scan(docs, benchmark, then=cut)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("hits") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(found)
