"""Session and table helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioflow import session
from folioflow.llm.kernels import release

__all__ = ["Scratch", "aside", "dropped", "fetched", "ranked", "required", "screened", "shared_dir", "ship", "table", "tidied", "written"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests on one machine, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def required(ddl: str, *optional: str) -> StructType:
    """A schema without nulls but in the ``optional`` columns; joins then add no null filters, which would part plans that could share a shuffle."""
    return StructType([StructField(f.name, f.dataType, f.name in optional) for f in StructType.fromDDL(ddl)])


#: Texts that go to a Python worker at once. Small, since the JVM, Arrow and the worker each hold a copy.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
#: Rows that a scan decodes at once: a whole column of texts lies in one array of the JVM.
SCAN_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Gives executors this package, and bounds the batches that scans make of texts and that Python workers get."""
    session.ship(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local = threading.local()


def _paths() -> set[str]:
    """Tables that this thread has written and not removed; other threads' runs in the same driver have their own."""
    if not hasattr(_local, "paths"):
        _local.paths = set()
    return _local.paths


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once as a table in the shared folder and read back: its lineage ends there, so lost executors cost no recomputation and no part is computed twice.

    The table goes when dropped() is called for the frame, and at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _at(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    _paths().add(path)
    return out


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def dropped(*frames: DataFrame) -> None:
    """Removes the tables of frames from written() that nothing reads any more."""
    for f in frames:
        _remove(f.sparkSession, f._table)


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
    _paths().discard(path)


def tidied(spark: SparkSession) -> None:
    """Collects the driver's garbage: only then does Spark free the shuffles and broadcasts that nothing refers to any more, and the heap gives memory back."""
    gc.collect()
    release()
    spark._jvm.System.gc()


class Scratch:
    """Tables that its thread writes while it is open; settled() writes a result and removes all others."""

    def __init__(self) -> None:
        self.before = set(_paths())

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        for path in _paths() - self.before - {out._table}:
            _remove(df.sparkSession, path)
        return out


#: Bits of the filter that fetched() sends to the scan: so many maps of 32768 bits.
_MAPS = 256


def screened(docs: DataFrame, need: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with ``_maybe``: false where the key is surely not in ``need``, told without moving rows.

    A bitmap of the needed keys' hashes, of fixed size, goes to the scan. As keys grow beyond it more rows are let through.
    """
    bits = _MAPS * 32768
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = need.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / 32768).alias("_m")).agg(F.bitmap_construct_agg(F.pmod(F.col("_p"), F.lit(32768))).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    rows = docs.withColumns({"_m": F.floor(place / 32768), "_at": F.pmod(place, F.lit(32768))}).join(F.broadcast(maps), "_m", "left")
    maybe = byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(_at % 8 as int)) as int)")) != 0
    return rows.withColumn("_maybe", F.coalesce(maybe, F.lit(False))).drop("_m", "_at", "_bits")


def fetched(docs: DataFrame, need: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in ``need`` (distinct keys); most others are never moved, and the join decides."""
    return screened(docs, need, key).where("_maybe").drop("_maybe").join(need, key)


def aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with its columns of these names under others, and the function that brings a result back to the frame's own columns."""
    clash = {c: f"_own_{c}" for c in df.columns if c in names}
    return df.withColumnsRenamed(clash), lambda out: out.drop(*clash).withColumnsRenamed({v: k for k, v in clash.items()}).select(*df.columns)


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, salts: int = 256) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each group, in the order (salt, order), where the salt is a hash of the order columns.

    No group is ever sorted in one task: rows are counted by (group, salt), the counts are summed up
    within the group (``salts`` rows for a group at most), and rows are numbered within (group, salt).
    The numbering is the same each time it is computed, but for rows alike in every order column.
    """
    from pyspark.sql import Window

    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    df = df.withColumn("_salt", salt)
    keys = [*group, "_salt"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_at", within).join(counts, keys).withColumn(rank, F.col("_before") + F.col("_at")).drop("_salt", "_at", "_before")
