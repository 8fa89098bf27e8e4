"""What every entry point needs of the Spark session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_shipped: set[str] = set()
#: Texts and rows that go to a Python worker at once: the JVM, Arrow and the worker each hold a copy, and what a step makes of them beside it.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def ship(spark: SparkSession) -> None:
    """Gives this package to every executor's Python, once per application: Spark's file server carries it there. Bounds what a worker gets at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    into = Path(tempfile.mkdtemp(prefix="folioflow-")) / "folioflow_package.zip"
    with zipfile.ZipFile(into, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(into))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
