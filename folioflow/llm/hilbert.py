"""Hilbert-curve sharding: rows in curve order over several quantised metadata columns, cut into runs of equal length.

DataFrame functions only. Rows are never sorted in one place: they are counted by curve cell, the
counts (as many as the curve has cells, whatever the input) are summed up in curve order, and a
row's place is its cell's start plus its place within the cell. Cells are split by a hash of the
row's key, so that a cell which holds most of the rows is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS, BITS = 4, 4
_HEX = "0123456789abcdef"


def text_bucket(c: Column) -> Column:
    """4 bits of a string: the first hexadecimal digit of its MD5; null counts as empty."""
    return F.instr(F.lit(_HEX), F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 1)) - 1


def size_bucket(c: Column) -> Column:
    """4 bits of a count: its number of binary digits, at most 15; null and negative count as 0."""
    n = F.greatest(F.coalesce(c.cast("long"), F.lit(0)), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.least(F.length(F.bin(n)), F.lit(15)))


def range_bucket(c: Column, low: int, high: int) -> Column:
    """4 bits of a number's place between ``low`` and ``high``; null counts as ``low``."""
    return F.floor((F.coalesce(c.cast("long"), F.lit(low)) - low) * 16 / (high - low + 1)).cast("int")


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a point of ``len(coords)`` dimensions with ``bits`` bits each (transposed-axes method)."""
    n = len(coords)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        p, x0, xi = q - 1, x[0], F.element_at(x, i + 1)
        swap = x0.bitwiseXOR(xi).bitwiseAND(p)
        first = F.when(xi.bitwiseAND(q) != 0, x0.bitwiseXOR(p)).otherwise(x0.bitwiseXOR(swap))
        other = F.when(xi.bitwiseAND(q) != 0, xi).otherwise(xi.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, first).when(k == i, other).otherwise(v))

    x = F.aggregate(steps, F.array(*[c.cast("int") for c in coords]), turn)

    def finish(x: Column) -> Column:
        gray = [x[0]]
        for k in range(1, n):
            gray.append(gray[-1].bitwiseXOR(x[k]))
        t = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda t, q: F.when(gray[-1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        place = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for g in gray:
                place = place * 2 + F.shiftright(g.bitwiseXOR(t), b).bitwiseAND(F.lit(1))
        return place

    return F.element_at(F.transform(F.array(x), finish), 1)


def hilbert_shards(df: DataFrame, coords: list[Column], order: list[str], n_shards: int) -> DataFrame:
    """Adds ``curve`` (place on the curve), ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, ... in the shard).

    Rows are ordered by curve place, then a hash of ``order[0]``, then ``order``; shard k holds the
    k-th of ``n_shards`` runs, whose lengths differ by one at most. Rows alike in every order column
    share a run of slots in any order. An empty table gives no rows.
    """
    axes = [f"_c{i}" for i in range(len(coords))]
    salt = F.substring(F.md5(F.coalesce(F.col(order[0]).cast("string"), F.lit(""))), 1, 2)
    cells = df.withColumns(dict(zip(axes, coords, strict=True)) | {"_salt": salt})
    counts = cells.groupBy(*axes, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # A cell has 256 salts at most, a curve block 256 cells, and the curve 256 blocks: each window is bounded by that.
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    per_cell = counts.groupBy(*axes).agg(F.sum("_n").alias("_n")).withColumn("curve", hilbert_index([F.col(a) for a in axes]))
    block = F.shiftright("curve", 8)
    per_block = per_cell.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_n"))
    per_block = per_block.select("_block", F.coalesce(F.sum("_n").over(upto().orderBy("_block")), F.lit(0)).alias("_b0"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    per_cell = per_cell.withColumn("_block", block).withColumn("_c", F.coalesce(F.sum("_n").over(upto("_block").orderBy("curve")), F.lit(0)))
    per_cell = per_cell.join(per_block, "_block").select(*axes, "curve", "_total", (F.col("_b0") + F.col("_c")).alias("_start"))
    salts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(upto(*axes).orderBy("_salt")), F.lit(0)))
    starts = salts.join(per_cell, axes).select(*axes, "_salt", "curve", "_total", (F.col("_start") + F.col("_s")).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*axes, "_salt").orderBy(*order)) - 1
    out = cells.withColumn("_at", within).join(starts, [*axes, "_salt"]).withColumn("_rank", F.col("_start") + F.col("_at"))
    shard = F.expr(f"cast((_rank * {n_shards}) div _total as int)")
    out = out.withColumn("shard", shard).withColumn("slot", F.col("_rank") - F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}"))
    return out.drop(*axes, "_salt", "_at", "_start", "_rank", "_total")


def manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard its rows and the least and greatest of each column: what a reader needs to skip files."""
    low_high = [f(c).alias(f"{name}_{c}") for c in columns for f, name in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *low_high)


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """documents with curve, shard and slot over (lang, source, n_chars, doc_id), by the law ``rows``.

    Null lang, source, text and n_chars count as empty or 0; repeated doc_ids and rows are placed one by one.
    """
    # only doc_id is read here
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = (ends.low, ends.high) if ends.low is not None else (0, 0)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    base = docs.select("doc_id", "lang", "source", "n_chars", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), crc.alias("text_crc32"))
    coords = [text_bucket(F.col("lang")), text_bucket(F.col("source")), size_bucket(F.col("n_chars")), range_bucket(F.col("doc_id"), low, high)]
    return hilbert_shards(base, coords, ["doc_id", "size", "text_crc32"], n_shards)
