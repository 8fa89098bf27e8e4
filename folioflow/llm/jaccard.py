"""Exact Jaccard join of shingle sets: small sets by fixed-size subsets, large ones by inverted lists.

All texts' tokens (shingles) are put into one order by how often the whole corpus holds them: rare ones
first, the commoner the later. Two sets that are alike enough share the first tokens they have in common
within a short prefix of that order. A small set posts every pair of tokens of its prefix, a large one the single
tokens. For common tokens, whose lists are long, all but the very large sets post pairs too, of a first and
an eighth common token, so that texts that share one sentence or line do not meet by it alone. Below which size pairs
are posted, for rare tokens and for common ones, follows from the lengths of lists, which are counted over
all documents. Sets near a boundary post both, since their partners may lie on the other side.

Equal sets are one class from the start. Within a posting list not all pairs are taken: first every
member against the member nearest to the front of the order, and then, of all others, those pairs whose
members these links have not joined yet. So every linked pair of different sets is either found or
already in one component, and components are exact. A bound from the positions, a bound from counts
of the sets' hashes, and the exact sets of both texts decide a pair, in this order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import aside, dropped, fetched, required, screened, ship, written
from folioflow.llm.graph import components
from folioflow.llm.kernels import NOT_SPACE, buffers, chunks, mix, release, shingle_set, shingles, words
from folioflow.llm.loads import Tally, bucket, bucket_loads, common_from

SHINGLE, PERCENT = 5, 80
#: What comparing one member of a list costs against posting one row.
SCAN_UNIT = 0.25
#: A list that may be as long is dealt to so many parts.
SALT_FROM, HOT_SALTS = 1024, 64
#: A pair of common tokens is that of the first and the GAP-th that two sets share; sets of up to LEAST_BORDER tokens always post plain pairs.
GAP, LEAST_BORDER = 8, 12


def sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; words are what white space parts, A-Z in lower case."""
    wh, woff = words(data, off, NOT_SPACE)
    sh = shingles(wh, k)
    return [shingle_set(wh[a:b], sh[a:b], k) for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True)]


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of the set."""
    if not len(s):
        return 0
    h = int(mix(s).sum(dtype=np.uint64)) ^ int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) * 0x9E3779B97F4A7C15 + len(s)
    return int(np.array([h & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64)[0])


def counts_of(s: np.ndarray) -> bytes:
    """How many of the set's hashes fall into each of as many parts as half the set, up to 255."""
    parts = 1 << max(5, int(len(s)).bit_length() - 2)
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) & (parts - 1), minlength=parts), 255).astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    """No two sets with these counts share more. A count of 255 may stand for more, so it bounds nothing."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if x.max() == 255 or y.max() == 255:
        return 1 << 40
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(axis=0), y.reshape(-1, n).sum(axis=0)).sum())


def enough(overlap: Column | int, n: Column | int, m: Column | int, percent: int = PERCENT):
    """Whether sets of n and m tokens that share ``overlap`` are linked: percent of their union."""
    return overlap * (100 + percent) >= (n + m) * percent


def prefix_length(n: int, shared: int, percent: int = PERCENT) -> int:
    """How many tokens of the order two linked sets' first ``shared`` common ones lie within."""
    return min(n, n + (-percent * n // 100) + shared)


def boundary(scan_cost: float, percent: int = PERCENT) -> int:
    """The largest size for which posting pairs costs no more than posting single tokens and scanning their lists."""
    p = 2 * (1 + scan_cost) - 1  # p (p + 1) / 2 = p (1 + scan_cost)
    n = LEAST_BORDER
    step = 1 << 24
    while step:  # prefixes grow with the size
        if prefix_length(n + step, 1, percent) <= p:
            n += step
        step >>= 1
    return n


@dataclass
class Order:
    """How common each bucket is (0: not told from chance; then by the logarithm of its tokens), and the sizes up to which sets post pairs of rare and of common tokens."""

    level: np.ndarray
    salted: int
    rare: int
    common: int


def order_of(loads: np.ndarray, percent: int = PERCENT) -> Order:
    """The order that the corpus's bucket counts make."""
    cut = common_from(loads)
    hot = loads >= cut
    steps = lambda x: 1 + np.floor(8 * np.log2(x / cut))
    level = np.zeros(len(loads), np.uint8)
    level[hot] = np.clip(steps(loads[hot]), 1, 255)
    cold = loads[~hot].astype(np.float64)
    # the sum of squares of the tokens' counts: that of the buckets' without what chance puts together
    alike = max(0.0, float((cold**2).sum() - cold.sum() ** 2 / max(1, len(cold))))
    short = max(0.0, alike / max(1.0, cold.sum()) - 1)
    long = float((loads[hot].astype(np.float64) ** 2).sum() / loads[hot].sum()) if hot.any() else 0.0
    rare = boundary(SCAN_UNIT * short, percent)
    return Order(level, int(max(1, steps(max(SALT_FROM, cut)))), rare, max(rare, boundary(SCAN_UNIT * long, percent)))


def profile(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per document id (doc_id, or for a null one a hash of the text), doc_id, text_hash, n, cls and counts; and, with ``slice`` set, each task's counts of that slice of the buckets, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        names = ["id", "doc_id", "text_hash", "n", "cls", "counts", "slice", "loads"]
        seen: set[int] = set()
        for batch, data, off in chunks(batches, "text"):
            found = sets(data, off, k)
            cls = [class_of(s) for s in found]
            for c, s in zip(cls, found, strict=True):
                if c not in seen:
                    seen.add(c)
                    tally.add(s)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([len(s) for s in found], pa.int64()), pa.array(cls, pa.int64()), pa.array([counts_of(s) for s in found], pa.binary()), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())], names=names)
        numbers, loads = tally.slices()
        none = pa.nulls(len(numbers), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(numbers), pa.binary()), pa.array(numbers, pa.int32()), pa.array(loads, pa.binary())], names=names)

    rows = docs.select(own_id(), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "id long, doc_id long, text_hash long, n long, cls long, counts binary, slice int, loads binary")


def own_id() -> Column:
    """What a row's text is fetched by."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id")


def posted(s: np.ndarray, level: np.ndarray, order: Order, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, whether their lists may be long, most) of one set in the order; see postings()."""
    n = len(s)
    if n <= order.rare:
        i, j = np.triu_indices(prefix_length(n, 2, percent), 1)
        yield mix(s[i] * np.uint64(0x9E3779B97F4A7C15) + s[j]), level[i] >= order.salted, n - j + 1
    if n * 100 <= order.rare * percent:
        return
    p = prefix_length(n, 1, percent)
    first = int(np.searchsorted(level[:p], 1))  # of the common tokens
    yield s[:first], np.zeros(first, bool), np.arange(n, n - first, -1)
    if first == p:
        return
    if n <= order.common:
        i, j = np.triu_indices(p - first)
        i, j = first + i, first + j + GAP - 1
        i, j = i[j < n], j[j < n]
        yield mix(s[i] * np.uint64(0xC2B2AE3D27D4EB4F) + s[j]), level[i] >= order.salted, n - j + GAP - 1
    if n * 100 > order.common * percent:
        yield s[first:p], level[first:p] >= order.salted, np.arange(n - first, n - p, -1)


def postings(docs: DataFrame, order: Order, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows (key, salt, cls, n, most): a set posts a key, and shares at most ``most`` tokens with a set whose first common key this is.

    Keys of lists that may be long are dealt to salts 0 and up; others have salt -1. A task posts a class once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        seen: set[int] = set()
        for _, data, off in chunks(batches, "text"):
            rows: list[tuple] = []
            for s in sets(data, off, k):
                n = len(s)
                cls = class_of(s)
                if not n or cls in seen:
                    continue
                seen.add(cls)
                level = order.level[bucket(s)]
                if level.any():
                    by = np.lexsort((s, level))
                    s, level = s[by], level[by]
                rows += [(*r, cls, n) for r in posted(s, level, order, percent) if len(r[0])]
            if not rows:
                continue
            sizes = [len(r[0]) for r in rows]
            key = np.concatenate([r[0] for r in rows])
            long = np.concatenate([r[1] for r in rows])
            cls = np.repeat(np.array([r[3] for r in rows], np.int64), sizes)
            salt = np.where(long, (mix(cls.view(np.uint64)) % np.uint64(HOT_SALTS)).astype(np.int32), np.int32(-1))
            n = np.repeat(np.array([r[4] for r in rows], np.int32), sizes)
            most = np.concatenate([r[2] for r in rows]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(cls), pa.array(n), pa.array(most)], names=["key", "salt", "cls", "n", "most"])

    return docs.select("doc_id", "text").mapInArrow(run, required("key long, salt int, cls long, n int, most int"))


def lists(posted: DataFrame) -> DataFrame:
    """The posting lists with at least two classes: key, cls, n, most, and the list's head: of its members the one with the fewest tokens before the key.

    One shuffle deals rows by (key, salt); a long list's parts are put together from one row for each salt.
    """
    spark = posted.sparkSession
    dealt = posted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "salt")
    head = F.min(F.struct((F.col("n") - F.col("most")).alias("before"), F.col("cls").alias("cls"), F.col("n").alias("n"), F.col("most").alias("most"))).alias("head")
    part = dealt.groupBy("key", "salt").agg(head, F.min("cls").alias("low"), F.max("cls").alias("high"), F.max("salt").alias("common"))
    # a filter on the counted salt stays above the shuffle, so that all three uses read the same one
    common = part.where("common >= 0").groupBy("key").agg(F.min("head").alias("_head"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    part = part.where("common >= 0 or low < high").join(common, "key", "left")
    part = part.select("key", "salt", F.coalesce("_head", "head").alias("head"), F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high")).where("low < high").drop("low", "high")
    return dealt.join(part, ["key", "salt"]).select("key", "cls", "n", "most", "head")


def _feasible(n: str, most: str, n2: str, most2: str, percent: int) -> Column:
    return enough(F.least(F.col(most), F.col(most2)), F.col(n), F.col(n2), percent)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of the candidate pairs of classes those that are linked, by the counts of their hashes first and then by the sets of their texts."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("ca").to_pylist(), batch.column("cb").to_pylist()
            n = (np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))).tolist()
            keep = pa.array([enough(overlap_bound(x, y), m, 0, percent) for x, y, m in zip(a, b, n, strict=True)], pa.bool_())
            yield batch.select(["a", "b", "da", "db"]).filter(keep)
        release()

    one = classes.select(F.col("cls").alias("a"), F.col("id").alias("da"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    two = classes.select(F.col("cls").alias("b"), F.col("id").alias("db"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    left = written(pairs.join(one, "a").join(two, "b").select("a", "b", "da", "db", "na", "nb", "ca", "cb").mapInArrow(bounded, "a long, b long, da long, db long"), "candidates")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, list[np.ndarray]] = {}
        for batch, data, off in chunks(batches, "ta"):
            mine = sets(data, off, k)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            other = batch.column("tb")
            keep = []
            for i, s in enumerate(mine):
                if b[i] not in last:
                    last = {b[i]: sets(*buffers(other.slice(i, 1)), k)}
                t = last[b[i]][0]
                shared = len(s) + len(t) - len(np.union1d(s, t))
                # a repeated doc_id may bring the text of another class
                keep.append(enough(shared, len(s), len(t), percent) and class_of(s) == a[i] and class_of(t) == b[i])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # each side's texts move once to meet their pairs, and those of the pairs' first texts once more to meet the others
    texts = docs.select(own_id(), "text")
    ta = fetched(texts, left.select(F.col("da").alias("id")).distinct(), "id").select(F.col("id").alias("da"), F.col("text").alias("ta"))
    tb = fetched(texts, left.select(F.col("db").alias("id")).distinct(), "id").select(F.col("id").alias("db"), F.col("text").alias("tb"))
    links = written(left.join(ta, "da").join(tb, "db").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long").distinct(), "links")
    dropped(left)
    return links


def components_of(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n, and of sets that are not empty the component's ``root`` and its least doc_id."""
    profiled = written(profile(docs, k), "profile")
    order = order_of(bucket_loads(profiled.where("slice is not null")), percent)
    members = profiled.where("slice is null").select("id", "doc_id", "text_hash", "n", "cls", "counts")
    least_id = F.coalesce(F.min("doc_id"), F.min("id"))
    classes = written(members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), least_id.alias("id"), F.min("n").alias("n"), F.min_by("counts", "id").alias("counts")), "classes")
    listed = written(lists(postings(docs, order, k, percent)), "lists")
    star = listed.where("cls <> head.cls").where(_feasible("n", "most", "head.n", "head.most", percent)).select(F.col("cls").alias("x"), F.col("head.cls").alias("y"))
    star = written(_pairs(star), "pairs")
    links = verified(star, classes, docs, k, percent)
    roots = components(links, "a", "b")

    # Lists that those links leave in several components: the pairs between components that no bound rules out.
    rooted = listed.select("key", "cls", "n", "most").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = written(rooted, "rooted")
    dropped(listed)
    span = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("most").alias("top"), F.min("n").alias("least")).where("low < high").drop("low", "high")
    span = written(span, "span")  # so that the join reads two plain shuffles, whose large parts Spark can split
    open_ = rooted.join(span, "key").where(enough(F.least("most", "top"), F.col("n"), F.col("least"), percent)).drop("top", "least")
    left, right = (open_.select("key", *(F.col(c).alias(c + s) for c in ("cls", "n", "most", "root"))) for s in "12")
    rest = left.join(right, "key").where("root1 < root2").where(_feasible("n1", "most1", "n2", "most2", percent)).select(F.col("cls1").alias("x"), F.col("cls2").alias("y"))
    rest = written(_pairs(rest).join(star, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = verified(rest, classes, docs, k, percent)
        if not more.isEmpty():
            roots = components(links.unionByName(more), "a", "b")
        dropped(more)
    dropped(star, rest, rooted, span, links)

    named = classes.select("cls", "doc_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("cls", "root", "component_id")
    return members.select("doc_id", "text_hash", "n", "cls").join(named, "cls", "left").drop("cls")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id that links reach).

    Texts with fewer than k words are one shingle; null, empty and blank texts have none and stay alone.
    Repeated doc_ids with different texts are different members with the same id. Rows with a null doc_id are
    members too; a component of such rows alone has a null component_id. Only doc_id and text are read, whatever other
    columns there are; an empty table gives no rows. Hashes have 64 bits: two different shingles count as one with a chance of about n^2 / 2^65.
    """
    ship(docs.sparkSession)
    found = components_of(docs, k, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each component one row, with all columns of docs: that with the least doc_id (null ids last; of several texts with this id that with the least hash).

    Of rows alike in doc_id and text one stays. Rows without words are linked with nothing and all stay.
    """
    ship(docs.sparkSession)
    found = written(components_of(docs, k, percent).where("n > 0"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    kept = written(rows.groupBy("root").agg(F.min(F.struct(rank.alias("r"), "times")).alias("k")).select("k.r.doc_id", "k.r.text_hash", "k.times"), "kept")
    docs, back = aside(docs, ("_key", "_maybe", "_m", "_at", "_bits", "_told", "_twice"))
    key = F.xxhash64("doc_id", "text_hash")
    go = rows.select(key.alias("_key")).distinct().join(kept.where("times = 1").select(key.alias("_key")), "_key", "left_anti")
    twice = kept.where("times > 1").select(key.alias("_key"), F.lit(True).alias("_twice"))
    # rows that surely stay go through unmoved; of all others this table decides
    told = written(go.join(twice, "_key", "left"), "told")
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    seen = screened(keyed, told.select("_key"), "_key")
    moved = seen.where("_maybe").drop("_maybe").join(told.withColumn("_told", F.lit(True)), "_key", "left")
    stay = moved.where("_told is null").select(*docs.columns)
    once = moved.where("_twice").dropDuplicates(["_key"]).select(*docs.columns)
    return back(seen.where("not _maybe").select(*docs.columns).unionByName(stay).unionByName(once))
