"""Substring deduplication with compact windows: passages of ``LEAST_WORDS`` words or more that other texts hold too.

Under one hash function, the Cartesian tree over the hashes of a text's tokens parts all its
subsequences of at least t tokens into compact windows, one for each tree node that spans t tokens: all
subsequences in a window have the node's token as their least. Tokens are runs of ``RUN`` words, and subsequences have ``SPAN`` runs,
25 words. The windows of two hash functions are joined as intervals: wherever two of them overlap by ``SPAN`` runs, all subsequences
in both have the same signature, the two least tokens, and the text posts it. Texts that post the same signature are
brought together, and two texts with 25 words in common post a common one.
That is complete for near copies too: each place where two passages differ
costs nine of both sides' shingles at least, of which a ninth may differ, so k such places take 81 k shingles or more
and leave, in k + 1 stretches, one of 21 shingles, which is 25 words (texts that repeat their own shingles aside).

Each text of a list is compared with the list's head; both whole texts decide. Where a later text of a list
has no passage there, it meets others of the list again, by shingles near the run which the head lacks there, and is compared
with the first text of each such list too. Last, members of lists that still lack a passage post every 50-word window around the run, and equal windows are
repeats. Only where two texts go on alike after the end of what both share with others, fewer than 50 words of
that may stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import aside, dropped, fetched, required, screened, ship, written
from folioflow.llm.jaccard import HOT_SALTS, SALT_FROM
from folioflow.llm.kernels import NOT_SPACE, buffers, chunks, mix, release, shingles, span_hash, spans, words
from folioflow.llm.loads import Tally, bucket, bucket_loads, common_from

LEAST_WORDS, SHINGLE, PERCENT = 50, 5, 80
#: A passage at ``PERCENT`` holds an exact stretch of so many words, and any such stretch a posted run of so many. See above.
WHOLE = LEAST_WORDS // 2
RUN = 8
SPAN = WHOLE - RUN + 1
#: Words between two matching stretches of one passage, at most.
GAP = 30
#: Words from a run to the next shingle of its passage, at most, if the run is no passage itself.
NEAR = LEAST_WORDS + GAP + SHINGLE
#: Of the shingles near a run the compact windows' of so many; two texts that share as many in a row there post one in common.
NEAR_WINDOW = 8
#: Rows of them that a task holds at once.
NEAR_ROWS = 1 << 18
_SEEDS = np.array([0, 0x9E3779B97F4A7C15], np.uint64)


def least_of_spans(tokens: np.ndarray, off: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """For every t consecutive tokens of a text, in order, the place of the least; and the tokens' order. Texts have the given n + 1 offsets. Equal hashes count from the left."""
    n = len(tokens)
    bits = np.uint64(max(20, int(n).bit_length()))
    order = (tokens >> bits << bits) | np.arange(n, dtype=np.uint64)
    if n < t:
        return np.zeros(0, np.int64), order
    low = order
    size = 1
    while size < t:  # the least of `size` tokens from each place on
        step = min(size, t - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    at = np.arange(len(low))
    low = low[at + t <= off[np.searchsorted(off, at, "right")]]
    return (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64), order


def windows(tokens: np.ndarray, off: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, left, right) of all Cartesian tree nodes that span at least t tokens: the node is the least token from left to right, both included. Such a node is the least of some t consecutive tokens, and the other way round."""
    least, order = least_of_spans(tokens, off, t)
    place = np.unique(least)
    # what bounds such a node is a lesser token, whose own span is longer, so it is one of them too, or the text's end
    rank, text = order[place], np.searchsorted(off, place, "right") - 1
    left, right = _lesser(rank, text), _lesser(rank[::-1], text[::-1])[::-1]
    right = np.where(right < 0, -1, len(place) - 1 - right)
    return place, np.where(left < 0, off[text], place[left] + 1), np.where(right < 0, off[text + 1], place[right]) - 1


def _lesser(rank: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The nearest place before each that has a lesser rank in the same text; -1 for none."""
    out = np.arange(len(rank)) - 1
    todo = np.arange(len(rank))
    while len(todo):
        to = out[todo]
        real = to >= 0
        end = real & (text[to] != text[todo])
        out[todo[end]] = -1
        go = real & ~end & (rank[to] > rank[todo])
        todo, to = todo[go], to[go]
        # what lies between a place and its nearest lesser one is greater still; a place behind may not be settled yet, then one step is made
        out[todo] = out[to]
    return out


def _grams(wh: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all runs of k words that end in their text, the words they start at, and the n + 1 offsets of each text's runs."""
    size = np.maximum(np.diff(woff) - k + 1, 0)
    off = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(int(off[-1])) - np.repeat(off[:-1], size) + np.repeat(woff[:-1], size)
    return shingles(wh, k)[place], place, off


def signatures(wh: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, keys) of all signatures: the word at which the first function's least run starts, and a hash of both functions' least runs.

    Both functions' windows are met in the order of the subsequences, so their overlaps are where either of the two changes.
    """
    grams, place, off = _grams(wh, woff, RUN)
    one, two = (mix(grams ^ seed) for seed in _SEEDS)
    first, second = least_of_spans(one, off, SPAN)[0], least_of_spans(two, off, SPAN)[0]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    first, second = first[new], second[new]
    return place[first], mix(one[first] ^ mix(two[second]))


def profile(docs: DataFrame) -> DataFrame:
    """Per document doc_id, cls (a hash of the text) and n_words; and, with ``slice`` set, each task's counts of that slice of the buckets of shingles, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        names = ["doc_id", "cls", "n_words", "slice", "loads"]
        seen: set[int] = set()
        for batch, data, off in chunks(batches, "text"):
            cls = span_hash(data, off[:-1], off[1:]).view(np.int64)
            wh, woff = words(data, off, NOT_SPACE)
            sh = shingles(wh, SHINGLE)
            new = np.array([c not in seen for c in cls.tolist()])
            seen.update(cls.tolist())
            tally.add(sh[np.repeat(new, np.diff(woff))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(cls), pa.array(np.diff(woff), pa.int64()), pa.nulls(len(cls), pa.int32()), pa.nulls(len(cls), pa.binary())], names=names)
        numbers, loads = tally.slices()
        none = pa.nulls(len(numbers), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(numbers, pa.int32()), pa.array(loads, pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, cls long, n_words long, slice int, loads binary")


def postings(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, salt, doc_id, place) of every signature; keys that start with a shingle whose list may be long are dealt to salts, others have -1. A task posts a text once."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        seen: set[int] = set()
        for batch, data, off in chunks(batches, "text"):
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            cls = span_hash(data, off[:-1], off[1:]).view(np.int64)
            wh, woff = words(data, off, NOT_SPACE)
            first = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):
                if c not in seen:
                    seen.add(c)
                    first[i] = True
            place, key = signatures(wh, woff)
            text = np.searchsorted(woff, place, "right") - 1
            use = first[text]
            text, place, key = text[use], place[use], key[use]
            common = hot[bucket(shingles(wh, SHINGLE)[place])]
            mine = ids[text]
            salt = np.where(common, (mix(mine.astype(np.uint64)) % np.uint64(HOT_SALTS)).astype(np.int32), np.int32(-1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(mine), pa.array((place - woff[text]).astype(np.int32))], names=["key", "salt", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, required("key long, salt int, doc_id long, place int"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, salt, doc_id) those of keys that two documents post, and all with a salt, each with its list's head: the first document of the same key and salt.

    Rows stream through; held back are only the rows of one text, as long as no other follows.
    """
    names = ["key", "salt", "doc_id", "place"]
    held, sent = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)], False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, doc, place = (np.concatenate([h, np.asarray(batch.column(c))]) for h, c in zip(held, names, strict=True))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        head = np.repeat(doc[start], size)
        shared = np.logical_or.reduceat((doc != head) | (salt >= 0), start)
        use = np.repeat(shared, size)
        use[: int(sent)] = False  # the head's row that went out before
        last, sent = int(start[-1]), bool(shared[-1])
        held = [x[last : last + 1 if sent else None] for x in (key, salt, doc, place)]
        i = np.flatnonzero(use)
        yield pa.RecordBatch.from_arrays([pa.array(x[i]) for x in (key, salt, doc, place, head)], names=[*names, "head"])
    release()


def lists(posted: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The signatures that two documents or more post: key, doc_id, place, and the list's head, its least doc_id; and the tables that hold them.

    One shuffle, by (key, salt), and a sort; a common key's parts are put together from one row for each salt.
    """
    tasks = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = posted.repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt", "doc_id")
    rows = written(dealt.mapInArrow(gathered, required("key long, salt int, doc_id long, place int, head long")), "lists")
    parts = rows.where("salt >= 0")
    heads = parts.groupBy("key").agg(F.min("head").alias("_head"), F.max("doc_id").alias("_high")).where("_head < _high")
    # written first, so that the join reads two plain shuffles, whose large parts Spark can split
    heads = written(heads, "heads")
    common = written(parts.join(heads, "key").select("key", "doc_id", "place", F.col("_head").alias("head")), "lists")
    dropped(heads)
    return rows.where("salt < 0").select("key", "doc_id", "place", "head").unionByName(common), [rows, common]


class Text:
    """A text's word hashes, and what comparing it with others asks for again and again."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.shingles = shingles(words, SHINGLE)[: max(0, len(words) - SHINGLE + 1)]
        self.kinds, self.first = np.unique(self.shingles, return_index=True)
        self.runs, self.runs_first = np.unique(shingles(words, LEAST_WORDS)[: max(0, len(words) - LEAST_WORDS + 1)], return_index=True)


def common_passages(x: np.ndarray, other: Text) -> list[tuple[int, int, int, int, int]]:
    """(start, end, start, end, percent) of the passages that two texts share, from the one's word hashes.

    Matching stretches of shingles are joined over gaps as long as the passage keeps ``PERCENT`` of its shingles in common.
    """
    if min(len(x), len(other.words)) < LEAST_WORDS:
        return []
    sx, sy = shingles(x, SHINGLE)[: len(x) - SHINGLE + 1], other.shingles
    kinds, first = other.kinds, other.first
    at = np.minimum(np.searchsorted(kinds, sx), len(kinds) - 1)
    i = np.flatnonzero(kinds[at] == sx)
    if not len(i):
        return []
    j = first[at[i]]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(i)]]) - 1
    found = []

    def close(p: list[int]) -> None:
        a, b, c, d, _ = p
        if min(b - a, d - c) + SHINGLE >= LEAST_WORDS:
            u, v = np.unique(sx[a : b + 1]), np.unique(sy[c : d + 1])
            same = len(np.intersect1d(u, v, assume_unique=True))
            if same * (100 + PERCENT) >= PERCENT * (len(u) + len(v)):
                found.append((a, b + SHINGLE, c, d + SHINGLE, 100 * same // (len(u) + len(v) - same)))

    now: list[int] | None = None
    for a, b, c, d in zip(i[lo].tolist(), i[hi].tolist(), j[lo].tolist(), j[hi].tolist(), strict=True):
        if now and a - now[1] <= GAP and 0 <= c - now[3] <= GAP:
            run = now[4] + b - a + 1
            if run * (100 + PERCENT) >= PERCENT * (b - now[0] + 1 + d - now[2] + 1):
                now = [now[0], b, now[2], d, run]
                continue
        if now and now[4] < b - a + 1 or now and now[1] - now[0] + SHINGLE >= LEAST_WORDS:
            close(now)
            now = [a, b, c, d, b - a + 1]
        elif now is None or b - a + SHINGLE >= LEAST_WORDS or a - now[1] > GAP:
            now = [a, b, c, d, b - a + 1]
        elif now[3] <= c:
            now = [a, b, c, d, b - a + 1]
    if now:
        close(now)
    return found + _uncovered(x, other, found)


def _uncovered(x: np.ndarray, other: Text, found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Exact passages outside those found: texts that repeat themselves match at several places, of which stretches follow one only."""
    gx = shingles(x, LEAST_WORDS)[: len(x) - LEAST_WORDS + 1]
    kinds, first = other.runs, other.runs_first
    at = np.minimum(np.searchsorted(kinds, gx), len(kinds) - 1)
    same = kinds[at] == gx
    for a, b, *_ in found:
        same[a : max(a, b - LEAST_WORDS + 1)] = False
    i = np.flatnonzero(same)
    if not len(i):
        return []
    j = first[at[i]]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(i)]]) - 1
    return [(int(i[a]), int(i[b]) + LEAST_WORDS, int(j[a]), int(j[b]) + LEAST_WORDS, 100) for a, b in zip(lo, hi, strict=True)]


_SPANS = "a long, b long, start int, end int, other_start int, other_end int, percent int"


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The passages of each pair (a, da, b, db) of classes with a doc_id of each."""
    texts = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[Text, int]] = {}
        for batch, data, off in chunks(batches, "ta"):
            cls = span_hash(data, off[:-1], off[1:]).view(np.int64)
            wh, woff = words(data, off, NOT_SPACE)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            rows: list[tuple] = []
            for i in range(len(a)):
                if b[i] not in last:
                    d2, o2 = buffers(batch.column("tb").slice(i, 1))
                    last = {b[i]: (Text(words(d2, o2, NOT_SPACE)[0]), int(span_hash(d2, o2[:-1], o2[1:]).view(np.int64)[0]))}
                y, other = last[b[i]]
                if cls[i] == a[i] and other == b[i]:  # a repeated doc_id may bring another text
                    rows += [(a[i], b[i], *p) for p in common_passages(wh[woff[i] : woff[i + 1]], y)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "start", "end", "other_start", "other_end", "percent"])

    # each side's texts move once to meet their pairs, and those of the pairs' first texts once more to meet the others
    ta = fetched(texts, pairs.select(F.col("da").alias("doc_id")).distinct()).select(F.col("doc_id").alias("da"), F.col("text").alias("ta"))
    tb = fetched(texts, pairs.select(F.col("db").alias("doc_id")).distinct()).select(F.col("doc_id").alias("db"), F.col("text").alias("tb"))
    return pairs.join(ta, "da").join(tb, "db").select("a", "b", "ta", "tb").mapInArrow(run, _SPANS).distinct()


def exact_windows(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the members (cls, doc_id, place) of exact lists those windows of ``LEAST_WORDS`` words around their runs that several texts hold, as passages with the first such text."""
    wanted = members.groupBy("cls", "doc_id").agg(F.array_sort(F.collect_set("place")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in chunks(batches, "text"):
            cls = span_hash(data, off[:-1], off[1:]).view(np.int64)
            wh, woff = words(data, off, NOT_SPACE)
            grams = shingles(wh, LEAST_WORDS)
            places, mine, ids = batch.column("places").to_pylist(), batch.column("cls").to_pylist(), batch.column("doc_id").to_pylist()
            keys, who, at = [], [], []
            for i, p in enumerate(places):
                last = int(woff[i + 1] - woff[i]) - LEAST_WORDS
                if cls[i] != mine[i] or last < 0:
                    continue
                starts = np.unique(np.concatenate([np.arange(x - (LEAST_WORDS - RUN), x + 1) for x in p]))
                starts = starts[(starts >= 0) & (starts <= last)]
                keys.append(grams[woff[i] + starts])
                who.append(np.full(len(starts), i))
                at.append(starts)
            if keys:
                w = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.array(mine, np.int64)[w]), pa.array(np.array(ids, np.int64)[w]), pa.array(np.concatenate(at).astype(np.int32))], names=["key", "cls", "doc_id", "place"])

    rows = fetched(docs.select("doc_id", "text"), wanted.select("doc_id").distinct()).join(wanted, "doc_id")
    windows = written(rows.select("doc_id", "cls", "text", "places").mapInArrow(run, "key long, cls long, doc_id long, place int"), "windows")
    heads = windows.groupBy("key").agg(F.min(F.struct("doc_id", "cls", "place")).alias("head"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").drop("low", "high")
    # written first, so that the join reads two plain shuffles, whose large parts Spark can split
    heads = written(heads, "heads")
    met = windows.join(heads, "key").where("cls <> head.cls").select(F.col("cls").alias("a"), F.col("head.cls").alias("b"), "place", (F.col("head.place") - F.col("place")).alias("shift")).distinct()
    # windows one word apart, with the same text and shift, are one passage; a window frame holds one pair of texts
    by = Window.partitionBy("a", "b", "shift").orderBy("place")
    met = met.withColumn("group", F.col("place") - F.row_number().over(by))
    met = met.groupBy("a", "b", "shift", "group").agg(F.min("place").alias("start"), F.max("place").alias("last"))
    return met.select("a", "b", "start", (F.col("last") + LEAST_WORDS).alias("end"), (F.col("start") + F.col("shift")).alias("other_start"), (F.col("last") + F.col("shift") + LEAST_WORDS).alias("other_end"), F.lit(100).alias("percent"))


def inside(runs: DataFrame, spans_of: DataFrame) -> DataFrame:
    """runs (cls, start, end, ...) with ``inside``: whether one of the spans (cls, start, end) holds the run.

    A sweep over each text; of spans that start alike the longest counts, so a frame has no more rows than the text has words.
    """
    reach = spans_of.groupBy("cls", "start").agg(F.max("end").alias("reach"))
    rows = runs.withColumn("reach", F.lit(None).cast("int")).unionByName(reach, allowMissingColumns=True)
    so_far = F.max("reach").over(Window.partitionBy("cls").orderBy("start"))  # those that start at the same word too
    return rows.withColumn("inside", F.coalesce(so_far >= F.col("end"), F.lit(False))).where(F.col("end").isNotNull()).drop("reach")


def unsettled(rows: DataFrame, found: DataFrame, firsts: DataFrame) -> DataFrame:
    """Those rows (key, cls, first, start, end) whose list of more than two has a later text without a passage found around start to end; with ``open``, whether the row is such, and ``head``, the list's first text's id; rows behind the last such are left out."""
    a, b = firsts.select(F.col("cls").alias("a"), F.col("first").alias("da")), firsts.select(F.col("cls").alias("b"), F.col("first").alias("db"))
    # only the later text of a pair gets its passage as a row
    later = found.join(a, "a").join(b, "b").select(F.when(F.col("da") > F.col("db"), F.struct(F.col("a").alias("cls"), "start", "end")).otherwise(F.struct(F.col("b").alias("cls"), F.col("other_start").alias("start"), F.col("other_end").alias("end"))).alias("s")).select("s.*")
    marked = written(inside(rows, later).withColumn("open", ~F.col("inside")).drop("inside"), "marked")
    heads = marked.groupBy("key").agg(F.min("first").alias("head"), F.max(F.when(F.col("open"), F.col("first"))).alias("top"), F.count(F.lit(1)).alias("members")).where("top > head and members > 2").drop("members")
    heads = written(heads, "heads")
    out = written(marked.join(heads, "key").where("first <= top").drop("top"), "unsettled")
    dropped(marked, heads)
    return out


def near_rest(places: DataFrame, named: DataFrame, tried: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` and, by the lists' runs (key, cls, first, start, end), the passages that texts share with others than their lists' heads.

    What two texts share around a run beyond what the head has too, they share by shingles near it that the head lacks there.
    So members of a run's list make lists again by those, and later texts that lack a passage are compared with the first of each.
    """
    firsts = written(named.select("cls", "first").distinct(), "firsts")
    runs = unsettled(places, found, firsts)
    by_doc = runs.groupBy(F.col("first").alias("doc_id"), "cls").agg(F.collect_set(F.struct("key", "start", "open", (F.col("first") == F.col("head")).alias("heads"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in chunks(batches, "text"):
            cls = span_hash(data, off[:-1], off[1:]).view(np.int64)
            wh, woff = words(data, off, NOT_SPACE)
            grams, place, goff = _grams(wh, woff, SHINGLE)
            at = windows(mix(grams), goff, NEAR_WINDOW)[0]
            grams, place = grams[at], place[at]
            mine, ids = np.asarray(batch.column("cls")), np.asarray(batch.column("doc_id"))
            listed_runs = batch.column("runs")
            text = np.repeat(np.arange(len(cls)), np.asarray(listed_runs.value_lengths()))
            key, start, is_open, heads = (x.to_numpy(zero_copy_only=False) for x in listed_runs.flatten().flatten())
            by = np.lexsort((start, key, text))
            text, key, start, is_open, heads = text[by], key[by], start[by], is_open[by], heads[by]
            lo = np.searchsorted(place, np.maximum(woff[text] + start - NEAR, woff[text]))
            hi = np.searchsorted(place, np.minimum(woff[text] + start + RUN + NEAR, woff[text + 1]))
            same = (text[1:] == text[:-1]) & (key[1:] == key[:-1])  # where a text has a run again, words that are near both count once
            lo[1:][same] = np.minimum(np.maximum(lo[1:], hi[:-1]), hi[1:])[same]
            size = np.where((cls == mine)[text], hi - lo, 0)
            cut = np.append(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), NEAR_ROWS), "right"), len(size))
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                n = size[x:y]
                who = np.repeat(np.arange(x, y), n)
                near = mix(grams[np.repeat(lo[x:y] - (np.cumsum(n) - n), n) + np.arange(len(who))] ^ mix(key[who].view(np.uint64)))
                u = np.unique(near ^ mix((text[who] * 2 + is_open[who]).astype(np.uint64)), return_index=True)[1]
                near, who = near[u], who[u]
                yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(mine[text[who]]), pa.array(ids[text[who]]), pa.array(is_open[who]), pa.array(heads[who])], names=["key", "cls", "first", "open", "heads"])

    texts = fetched(docs.select("doc_id", "text"), by_doc.select("doc_id").distinct()).join(by_doc, "doc_id")
    near = written(texts.select("doc_id", "cls", "text", "runs").mapInArrow(run, "key long, cls long, first long, open boolean, heads boolean"), "near")
    keys = near.groupBy("key").agg(F.min("first").alias("db"), F.min_by("cls", "first").alias("b"), F.max(F.when(F.col("open"), F.col("first"))).alias("top"), F.max("heads").alias("heads")).where("not heads and top > db").select("key", "b", "db")
    keys = written(keys, "keys")
    pairs = near.where("open").join(keys, "key").where("cls <> b").select(F.col("cls").alias("a"), F.col("first").alias("da"), "b", "db").distinct()
    tried = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    pairs = written(pairs.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(tried, ["x", "y"], "left_anti").drop("x", "y"), "pairs")
    if not pairs.isEmpty():
        found = found.unionByName(written(compared(pairs, docs), "passages"))
    dropped(runs, near, keys, pairs, firsts)
    return found


def repeats(docs: DataFrame) -> DataFrame:
    """Per repeated passage: doc_id, start, end (words), other_id, other_start, other_end, percent (similarity of their shingles).

    ``other_id`` is the first document (least doc_id) of a list that the passage was met in, ``doc_id`` a later one, so a passage that
    many documents hold has a row for each of them but the first. A text that equals an earlier one
    has one row, as a whole, if it has ``LEAST_WORDS`` words; its passages are those of the earlier one. Words are what white
    space parts, A-Z in lower case. Null, empty and short texts have no rows. Rows of docs alike in doc_id
    and text count as one, those alike in doc_id only as one document, and those without a doc_id are left out.
    """
    ship(docs.sparkSession)
    docs = docs.where(F.col("doc_id").isNotNull())
    profiled = written(profile(docs), "profile")
    loads = bucket_loads(profiled.where("slice is not null"))
    members = profiled.where("slice is null and n_words >= " + str(LEAST_WORDS)).select("doc_id", "cls", "n_words").distinct()
    first = members.groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = written(members.join(first, "cls"), "classes")  # of copies the first stands for all
    listed, tables = lists(postings(docs, loads >= max(SALT_FROM, common_from(loads))))
    meet = listed.where("doc_id <> head").select("doc_id", "head").distinct().join(named.select("doc_id", F.col("cls").alias("a"), F.col("first").alias("da")), "doc_id").join(named.select(F.col("doc_id").alias("head"), F.col("cls").alias("b"), F.col("first").alias("db")), "head")
    pairs = written(meet.where("a <> b").select("a", "da", "b", "db").distinct(), "pairs")
    found = written(compared(pairs, docs), "passages")
    places = listed.join(named.select("doc_id", "cls", "first"), "doc_id").select("key", "cls", "first", F.col("place").alias("start"), (F.col("place") + RUN).alias("end"))
    places = written(places.distinct(), "places")
    dropped(profiled, *tables)
    found = near_rest(places, named, pairs, found, docs)
    dropped(pairs)

    # Exact runs that no passage found so far covers: their whole lists go on to windows.
    sides = found.select(F.col("a").alias("cls"), "start", "end").union(found.select("b", "other_start", "other_end"))
    told = written(inside(places.drop("first"), sides), "runs")
    keys = written(told.where("not inside").select("key").distinct(), "keys")
    again = written(told.join(keys, "key").select("cls", F.col("start").alias("place")).distinct(), "missed")
    dropped(places, told, keys)
    if not again.isEmpty():
        found = found.unionByName(written(exact_windows(again.join(named.select("cls", F.col("first").alias("doc_id")).distinct(), "cls"), docs), "passages"))

    firsts = named.select("cls", "first").distinct()
    a, b = firsts.select(F.col("cls").alias("a"), F.col("first").alias("da")), firsts.select(F.col("cls").alias("b"), F.col("first").alias("db"))
    found = found.join(a, "a").join(b, "b").where("da <> db")
    turn = F.col("da") < F.col("db")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    rows = found.select(pick("da", "db").alias("doc_id"), pick("start", "other_start").alias("start"), pick("end", "other_end").alias("end"), pick("db", "da").alias("other_id"), pick("other_start", "start").alias("other_start"), pick("other_end", "end").alias("other_end"), "percent")
    equal = named.where("doc_id <> first")
    n = F.col("n_words").cast("int")
    equal = equal.select("doc_id", F.lit(0).alias("start"), n.alias("end"), F.col("first").alias("other_id"), F.lit(0).alias("other_start"), n.alias("other_end"), F.lit(100).alias("percent"))
    return rows.distinct().unionByName(equal)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without those passages that an earlier document holds; documents of which no word is left go.

    Others are kept as they are. Where text is cut, n_chars (if the column is there) is counted anew. All rows with
    the doc_id of a passage are cut, so repeated doc_ids should have been resolved before.
    """
    # of spans that start alike the longest: no more than the text has words
    longest = repeats(docs).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    spans_of = written(longest.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_spans")), "spans")
    docs, back = aside(docs, ("_spans", "_maybe", "_m", "_at", "_bits"))
    # documents that surely have no spans go through as they are, unmoved
    rows = screened(docs, spans_of.select("doc_id"))
    clean = rows.where("not _maybe").select(*docs.columns)
    marked = rows.where("_maybe").join(spans_of, "doc_id", "left").select(*docs.columns, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            cuts = batch.column(names.index("_spans")).to_pylist()
            if any(cuts):
                texts = batch.column(at).to_pylist()
                keep = np.ones(len(texts), bool)
                for i, c in enumerate(cuts):
                    if c and texts[i]:
                        raw = texts[i].encode()
                        starts, ends, _ = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_SPACE)
                        parts, last, words_left = [], 0, len(starts)
                        upto = 0
                        for s, e in sorted((x["start"], min(x["end"], len(starts))) for x in c):
                            s = max(s, upto)
                            if s >= e:
                                continue
                            parts.append(raw[last : starts[s]])
                            last, upto, words_left = int(ends[e - 1]), e, words_left - (e - s)
                        texts[i] = (b"".join(parts) + raw[last:]).decode()
                        keep[i] = words_left > 0
                batch = batch.set_column(at, names[at], pa.array(texts, pa.string())).filter(pa.array(keep))
            yield batch
        release()

    out = marked.mapInArrow(run, marked.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(clean.unionByName(out.select(*docs.columns)))
