"""Phrases whose words belong together, mined by language.

Texts are cut into pieces and identical pieces of a language become one with a multiplicity. Phrases of one to four words are counted, weighted by
it, level by level: a phrase can reach the least count only if all shorter ones in it do, so each level posts only phrases whose parts did.
That is told by a bit map of fixed size, which may let too many through but never drops one. Every task adds up
what it finds, packs it by hash bucket, and a bucket's rows are counted by duckdb, which spills to the shared folder beyond its memory limit.

What a phrase is made of lies in other buckets: lookup requests for the parts of every candidate are shuffled to where the parts'
counts are, and so are those of longer candidates to the shorter ones that they hold.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, shared_dir, ship, written
from folioflow.llm.kernels import LOWER, buffers, chunks, mix, release, shingles, span_hash, spans

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes where a longer one that holds it has this share of its count.
HELD_PERCENT = 80
NO_LANG = "und"
SCORE = 2_000_000
#: The map of frequent phrases has 2 ** MAP_BITS bits, and travels in so many slices.
MAP_BITS, SLICES = 25, 64
#: Phrases that a task adds up before it passes them on, and what a bucket's duckdb holds in memory.
HELD_ROWS, BUCKET_MEMORY = 1 << 19, "192MB"
INSERT_ROWS = 1 << 17

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09]] = False
_END = np.zeros(256, bool)
_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACE = np.ones(256, bool)
_SPACE[0x20] = False


def _taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after the other, with a blank after each if ``gap``; and their n + 1 offsets."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size + gap)])
    at = np.arange(int(off[-1])) - np.repeat(off[:-1] - starts, size + gap)
    out = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(0, np.uint8)
    if gap:
        out[off[1:] - 1] = 0x20
    return out, off


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _lang_codes(col: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).fill_null(NO_LANG).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def _lang_seeds(langs: list[str]) -> np.ndarray:
    data, off = buffers(pa.array(langs, pa.string()))
    return mix(span_hash(data, off[:-1], off[1:]) ^ np.uint64(0x2545F4914F6CDD1D))


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, texts): every piece that has words, its words in lower case with one blank between, and the text that it is of."""
    low = LOWER[data]
    starts, ends, woff = spans(low, off, _WORD & ~_END)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(woff, np.arange(len(starts)), "right") - 1
    marks = np.concatenate([[0], np.cumsum(_END[low])])
    new = np.ones(len(starts), bool)  # of a piece: another text, or an end mark between
    new[1:] = (text[1:] != text[:-1]) | (marks[starts[1:]] != marks[ends[:-1]])
    out, word_off = _taken(low, starts, ends, gap=True)
    first = np.flatnonzero(new)
    begin, end = word_off[first], word_off[np.append(first[1:], len(starts))] - 1  # without the last blank
    body, piece_off = _taken(out, begin, end)
    return body, piece_off, text[first]


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, times): the distinct pieces of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in chunks(batches, "text"):
            body, piece_off, text = cut(data, off)
            if not len(text):
                continue
            codes, langs = _lang_codes(batch.column(0))
            lang = codes[text]
            key = mix(span_hash(body, piece_off[:-1], piece_off[1:]) ^ _lang_seeds(langs)[lang])
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            own, own_off = _taken(body, piece_off[first], piece_off[first + 1])
            yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(lang[first])), _strings(own, own_off).cast(pa.string()), pa.array(times.astype(np.int64))], names=["lang", "piece", "times"])

    told = docs.select("lang", "text").mapInArrow(run, "lang string, piece string, times long")
    return told.groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Held:
    """Phrases of one task, added up: packed rows (bucket, lang, phrases and weights as one Arrow stream) come out as it fills."""

    def __init__(self, buckets: int, rows: int = HELD_ROWS) -> None:
        self.buckets, self.rows, self.parts, self.size = buckets, rows, [], 0

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, times: np.ndarray, lang: np.ndarray, langs: list[str]) -> Iterator[pa.RecordBatch]:
        if not len(hashes):
            return
        h, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        weight = np.zeros(len(h), np.int64)
        np.add.at(weight, inverse, times)
        body, off = _taken(data, starts[first], ends[first])
        self.parts.append((h, weight, _strings(body, off), pa.array(langs).take(pa.array(lang[first]))))
        self.size += len(h)
        if self.size >= self.rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        hashes = np.concatenate([p[0] for p in self.parts])
        h, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        weight = np.zeros(len(h), np.int64)
        np.add.at(weight, inverse, np.concatenate([p[1] for p in self.parts]))
        at = pa.array(first)
        phrases = pa.chunked_array([p[2] for p in self.parts]).take(at)
        codes, langs = _lang_codes(pa.chunked_array([p[3] for p in self.parts]).take(at))
        self.parts, self.size = [], 0
        bucket = ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        by = np.lexsort((bucket, codes))
        group = codes[by] * self.buckets + bucket[by]
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        table = pa.table({"phrase": phrases.take(pa.array(by)), "times": weight[by]}).combine_chunks()
        rows: tuple[list, list, list] = ([], [], [])
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(by)], strict=True):
            rows[0].append(int(group[a]) % self.buckets)
            rows[1].append(langs[int(group[a]) // self.buckets])
            rows[2].append(_packed(table.slice(a, b - a)))
        for a in range(0, len(edge), 256):
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][a : a + 256], pa.int32()), pa.array(rows[1][a : a + 256]), pa.array(rows[2][a : a + 256], pa.binary())], names=["bucket", "lang", "packed"])


def _packed(table: pa.Table) -> bytes:
    table = pa.table({"phrase": table["phrase"].cast(pa.string()), "times": table["times"]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def found(distinct: DataFrame, sizes: tuple[int, ...], bits: bytes | None, buckets: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """(bucket, lang, packed): phrases of ``sizes`` words in the pieces, with their weights. With ``bits`` only those whose parts of ``sizes[0] - 1`` words are all in that map."""
    shared = distinct.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8) if shared.value is not None else None
        held = Held(buckets, held_rows)
        for batch, data, off in chunks(batches, "piece"):
            codes, langs = _lang_codes(batch.column(0))
            seeds = _lang_seeds(langs)
            starts, ends, woff = spans(data, off, _SPACE)
            wh = span_hash(data, starts, ends)
            piece = np.searchsorted(woff, np.arange(len(starts)), "right") - 1
            left = woff[1:][piece] - np.arange(len(starts))  # words from here to the piece's end
            lang, times = codes[piece], np.asarray(batch.column(2))[piece]
            part = sizes[0] - 1
            frequent = _in_map(bits, mix(shingles(wh, part) ^ seeds[lang])) if part else None
            for k in sizes:
                use = left >= k
                if part:
                    use[len(use) - min(len(use), k - part) :] = False
                    for j in range(k - part + 1):
                        use[: len(use) - j] &= frequent[j:]
                at = np.flatnonzero(use)
                if len(at):
                    yield from held.add(data, starts[at], ends[at + k - 1], mix(shingles(wh, k)[at] ^ seeds[lang[at]]), times[at], lang[at], langs)
        yield from held.flush()
        release()

    return distinct.select("lang", "piece", "times").mapInArrow(run, "bucket int, lang string, packed binary")


def counted(packed: DataFrame, least: int, spill: str, buckets: int) -> DataFrame:
    """(lang, phrase, f) of phrases with at least ``least`` occurrences, and for each language a row with a null phrase that has a bucket's sum. A bucket is counted by one duckdb, which spills to ``spill``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shutil

        import duckdb

        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        own = Path(spill) / uuid.uuid4().hex
        own.mkdir(parents=True)
        try:
            with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": str(own), "preserve_insertion_order": False}) as con:
                con.execute("CREATE TABLE posted (lang VARCHAR, phrase VARCHAR, times BIGINT)")
                waiting: list[pa.Table] = []

                def put() -> None:
                    rows = pa.concat_tables(waiting)
                    waiting.clear()
                    con.register("rows_now", rows)
                    con.execute("INSERT INTO posted SELECT lang, phrase, times FROM rows_now")
                    con.unregister("rows_now")

                batch = first
                while batch is not None:
                    for lang, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                        rows = pa.ipc.open_stream(raw.as_buffer()).read_all()
                        waiting.append(rows.append_column("lang", pa.array([lang] * len(rows), pa.string())))
                        if sum(map(len, waiting)) >= INSERT_ROWS:
                            put()
                    batch = next(batches, None)
                if waiting:
                    put()
                for query in (f"SELECT lang, phrase, sum(times)::BIGINT AS f FROM posted GROUP BY ALL HAVING sum(times) >= {least}", "SELECT lang, NULL::VARCHAR AS phrase, sum(times)::BIGINT AS f FROM posted GROUP BY ALL"):
                    yield from con.execute(query).to_arrow_reader(1 << 16) if hasattr(con, "to_arrow_reader") else con.execute(query).fetch_record_batch(1 << 16)
        finally:
            shutil.rmtree(own, ignore_errors=True)
        release()

    return packed.repartition(buckets, "bucket").mapInArrow(run, "lang string, phrase string, f long")


def bit_map(phrases: DataFrame, map_bits: int = MAP_BITS) -> bytes:
    """A map of 2 ** ``map_bits`` hashed bits with those of the phrases set; tasks' maps travel in packed slices."""
    size = (1 << map_bits) // 8

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch, data, off in chunks(batches, "phrase"):
            codes, langs = _lang_codes(batch.column(0))
            starts, ends, woff = spans(data, off, _SPACE)
            wh = span_hash(data, starts, ends)
            n = np.diff(woff)
            for k in np.unique(n).tolist():  # phrases of as many words
                own = np.flatnonzero(n == k)
                at = (mix(shingles(wh, k)[woff[own]] ^ _lang_seeds(langs)[codes[own]]) & np.uint64(8 * size - 1)).astype(np.int64)
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = bits.reshape(SLICES, -1)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in full], pa.binary())], names=["slice", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint8)
                whole[i] = whole[i] | part if i in whole else part
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in whole.values()], pa.binary())], names=["slice", "bits"])

    schema = "slice int, bits binary"
    tasks = min(SLICES, int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((SLICES, size // SLICES), np.uint8)
    for r in phrases.select("lang", "phrase").mapInArrow(local, schema).repartition(tasks, "slice").mapInArrow(joined, schema).collect():
        out[r.slice] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out.tobytes()


def spill_dir(spark) -> str:
    """A folder for what duckdb spills: in the shared folder, which must be a path of the file system."""
    at = urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError("duckdb spills to a mounted folder: give one as spill")
    return f"{at.path}/spill-{uuid.uuid4().hex}"


def _joined(words: str, first, size):
    return F.array_join(F.slice(F.col(words), first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, spill: str | None = None, map_bits: int = MAP_BITS, held_rows: int = HELD_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words of each language.

    Null texts and texts without words add nothing; a null lang is ``und``. Repeated rows count each time. Only lang and text are
    read, whatever other columns there are; an empty table gives no rows. Ties go by a, then by the phrase's bytes. Phrases are counted as
    strings; within a task equal ones are told by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spill = spill or spill_dir(spark)
    distinct = written(pieces(docs), "pieces")
    levels, bits = [], None
    for sizes in ((1,), (2,), tuple(range(3, longest + 1))):
        if sizes:
            levels.append(written(counted(found(distinct, sizes, bits, buckets, held_rows), least, spill, buckets), "phrases"))
            bits = bit_map(levels[-1].where("phrase is not null"), map_bits) if sizes[-1] < longest else None
    dropped(distinct)
    totals = levels[0].where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every = every.where("phrase is not null")

    candidates = every.where("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    k, size = F.col("k"), F.size("words")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined("words", F.lit(1), k).alias("left"), _joined("words", k + 1, size - k).alias("rest"))
    parts = lambda c, f: every.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    met = cuts.join(parts("left", "l"), ["lang", "left"]).join(parts("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCORE} div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    longer = candidates.where(size > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    longer = longer.select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(1), size - k + 1)).alias("i"))
    within = longer.select("lang", _joined("words", F.col("i"), k).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * HELD_PERCENT))

    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    best = written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "best.score"), "best")
    out = written(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    dropped(best, *levels)
    return out
