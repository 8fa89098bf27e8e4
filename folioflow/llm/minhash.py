"""Near duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

One hash function deals a set's shingles to ``BINS`` bins and keeps the least of each; an empty bin takes the value of a
bin that is not, found by a second hash of (bin, attempt), which is the same for every set. So each bin agrees with the chance of the
sets' similarity, however small they are. ``ROWS`` bins make a band, and texts that agree in a band share a bucket.

Equal sets are one class from the start. In a bucket every class meets the bucket's centre only: that class which has most company over all
its buckets. Of a text and its many altered copies it is the text, since copies fall out of its buckets one here and one there, and copies need not be
alike among each other. A link between two other texts of the bucket, one of them not linked with the centre, is still found: the two must deviate
from the centre in the same tokens, so lists by centre and first deviations bring them together, and texts that are altered each in its own way
never meet. The full sets of both texts decide every pair. At a similarity of 0.85 a link is in no bucket with a chance of 7e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, fetched, ship, written
from folioflow.llm.graph import components
from folioflow.llm.jaccard import SHINGLE, class_of, counts_of, own_id, sets, verified
from folioflow.llm.kernels import buffers, chunks, mix, release

PERCENT = 85
ROWS, BANDS = 5, 32
BINS = ROWS * BANDS
_SEED, _TRY, _BAND = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def one_permutation(shingle_sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled), a row of ``BINS`` for each set: the least hash in the bin, where one fell into it."""
    sizes = np.array([len(s) for s in shingle_sets], np.int64)
    h = mix((np.concatenate(shingle_sets) if len(shingle_sets) else np.zeros(0, np.uint64)) ^ _SEED)
    cell = np.repeat(np.arange(len(sizes)), sizes) * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    low = h & np.uint64(0xFFFFFFFF)
    order = np.argsort(cell.astype(np.uint64) << np.uint64(32) | low)  # the least of a cell comes first
    at, first = np.unique(cell[order], return_index=True)
    values, filled = np.zeros(len(sizes) * BINS, np.uint64), np.zeros(len(sizes) * BINS, bool)
    values[at], filled[at] = low[order][first], True
    return values.reshape(-1, BINS), filled.reshape(-1, BINS)


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """The values with every empty bin filled from another one of the set; a set without any stays as it is."""
    out = values.copy()
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = np.uint64(0)
    while len(row):
        attempt += np.uint64(1)
        # which bin is tried depends on the empty one and the attempt alone
        tries = (mix(np.arange(BINS, dtype=np.uint64) * _TRY + attempt) % np.uint64(BINS)).astype(np.int64)[col]
        hit = filled[row, tries]
        out[row[hit], col[hit]] = values[row[hit], tries[hit]]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(shingle_sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit bucket key for each set and band. The keys of empty sets mean nothing."""
    v = densified(*one_permutation(shingle_sets)).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _BAND, v.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * _TRY + v[:, :, k])
    return key


def profile(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per row id (what its text is fetched by), doc_id, n, cls (a name of the set), counts of its hashes, and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in chunks(batches, "text"):
            found = sets(data, off, k)
            keys = band_keys(found).view(np.int64)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array([class_of(s) for s in found], pa.int64()), pa.array([counts_of(s) for s in found], pa.binary()), packed],
                names=["id", "doc_id", "n", "cls", "counts", "keys"],
            )

    rows = docs.select(own_id(), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "id long, doc_id long, n long, cls long, counts binary, keys array<long>")


def deviation(s: np.ndarray, t: np.ndarray, percent: int = PERCENT) -> tuple[bool, np.ndarray, int, int]:
    """Whether the sets s and t (a centre) are linked; the first tokens that only one of them has, those of s before those of t; how many of them count among sets that are not linked; and how many there are in all.

    Two sets x and y are linked where |x + y| <= q (|x| + |y|), + for the tokens that only one has and q for (100 - percent) / (100 + percent). What x + y
    lacks of x + c and y + c they have in common, so linked sets share (|x + c| + |y + c| - q (|x| + |y|)) / 2 of their deviations at least. If y is not linked
    with c, |y + c| > q (|y| + |c|), which leaves over (|x + c| - q (|x| - |c|)) / 2. If x is linked with c, |x + c| >= ||x| - |c||, which leaves
    (|y + c| - q (|y| + |c|)) / 2. Of tokens in one order so many of the first ones of both hold one in common.
    """
    own, lost = np.setdiff1d(s, t, assume_unique=True), np.setdiff1d(t, s, assume_unique=True)
    d, n, m, full, q = len(own) + len(lost), len(s), len(t), 100 + percent, 100 - percent
    linked = d * full <= q * (n + m)
    short = min(d, d - (d * full - q * (n - m)) // (2 * full))
    most = short if linked else max(short, min(d, d - -((q * (n + m) - d * full) // (2 * full)) + 1))
    return linked, np.concatenate([own, lost])[:most], short, d


def compared(star: DataFrame, classes: DataFrame, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(x, c, n, linked, short, d, tokens) of every class and its centre, from the full sets of both texts; see deviation()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch, data, off in chunks(batches, "tx"):
            mine = sets(data, off, k)
            x, c, other = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            rows = []
            for i, s in enumerate(mine):
                if c[i] not in last:
                    last = {c[i]: sets(*buffers(other.slice(i, 1)), k)[0]}
                t = last[c[i]]
                if class_of(s) == x[i] and class_of(t) == c[i]:  # a repeated doc_id may bring the text of another class
                    rows.append((x[i], c[i], *deviation(s, t, percent), len(s)))
                if class_of(t) != c[i]:
                    last = {}
            linked, tokens, short, d, n = ([r[j] for r in rows] for j in range(2, 7))
            sizes = np.concatenate([[0], np.cumsum([len(v) for v in tokens], dtype=np.int64)]).astype(np.int32)
            flat = (np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)).view(np.int64)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(short, pa.int32()), pa.array(d, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "c", "n", "linked", "short", "d", "tokens"])
        release()

    ids = lambda a, b: classes.select(F.col("cls").alias(a), F.col("id").alias(b))
    pairs = star.join(ids("x", "dx"), "x").join(ids("c", "dc"), "c")
    texts = docs.select(own_id(), "text")
    need = lambda c: pairs.select(F.col(c).alias("id")).distinct()
    tx = fetched(texts, need("dx"), "id").select(F.col("id").alias("dx"), F.col("text").alias("tx"))
    tc = fetched(texts, need("dc"), "id").select(F.col("id").alias("dc"), F.col("text").alias("tc"))
    rows = pairs.join(tx, "dx").join(tc, "dc").select("x", "c", "tx", "tc").mapInArrow(run, "x long, c long, n long, linked boolean, short int, d long, tokens array<long>")
    return rows.dropDuplicates(["x", "c"])


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (doc_id = component_id).

    Texts with fewer than k words are one shingle; null, empty and blank texts have none, stay alone and are kept. Rows with a repeated doc_id are
    rows of their own with that id; rows with a null doc_id are members too, but a component of such rows alone has a null
    component_id, and they are not kept. Only doc_id and text are read, whatever other columns there are; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = written(profile(docs, k), "profile")
    least_id = F.coalesce(F.min("doc_id"), F.min("id"))
    one = F.min_by(F.struct("counts", "keys"), "id")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), least_id.alias("id"), F.min("n").alias("n"), one.alias("one"))
    classes = written(classes.select("cls", "doc_id", "id", "n", "one.counts", "one.keys"), "classes")

    posted = classes.select("cls", "n", F.explode("keys").alias("key"))
    # Counts are added up in every task before they move. What is read back from a table is a plain shuffle, so that Spark can split the
    # parts that long buckets make.
    sizes = written(posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = written(posted.join(sizes, "key"), "buckets")
    fame = written(shared.groupBy("cls").agg(F.sum("size").alias("fame")), "fame")
    listed = written(shared.join(fame, "cls").select("key", "cls", "n", "fame"), "buckets")
    dropped(sizes, shared, fame)
    heads = written(listed.groupBy("key").agg(F.max(F.struct("fame", "cls", "n")).alias("head")), "heads")
    star = listed.join(heads, "key").where("cls <> head.cls").select(F.col("cls").alias("x"), F.col("head.cls").alias("c")).distinct()
    met = written(compared(written(star, "star"), classes, docs, k, percent), "compared")
    dropped(heads, listed)
    links = met.where("linked").select(F.col("x").alias("a"), F.col("c").alias("b"))
    roots = components(links, "a", "b")

    rooted = met.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    open_ = met.where("not linked").select("c").distinct()
    posts = written(rooted.join(open_, "c").select("c", "x", "n", "root", "linked", "short", "d", F.posexplode("tokens").alias("at", "token")), "deviations")
    left, right = (posts.select("c", "token", *(F.col(n).alias(n + i) for n in ("x", "n", "root", "linked", "short", "d", "at"))) for i in "12")
    # what follows the first deviation in common bounds how many there are; at later ones the bound is lower, and the pair has passed by then or never does
    within = F.least(F.col("d1") - F.col("at1"), F.col("d2") - F.col("at2")) * (2 * (100 + percent)) >= (F.col("d1") + F.col("d2")) * (100 + percent) - (F.col("n1") + F.col("n2")) * (100 - percent)
    both = left.where("not linked1").join(right, ["c", "token"]).where("root1 <> root2").where(within).where("linked2 or (x1 < x2 and at1 < short1 and at2 < short2)")
    rest = written(_pairs(both.select(F.col("x1").alias("x"), F.col("x2").alias("y"))), "pairs")
    if not rest.isEmpty():
        more = verified(rest, classes, docs, k, percent)
        if not more.isEmpty():
            roots = components(links.unionByName(more), "a", "b")
        dropped(more)
    dropped(rest, posts, met)

    named = classes.select("cls", "doc_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
