"""What goes into a stage, what it rejects and what comes out, told by the job that runs it and not by a second one."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STAGE = "stage string, rows_in long, rejected long, rows_out long"


class Stages:
    """Filters in a row, each observed. Counts are there once an action has run over the last stage's rows; ``told`` is then called for each stage."""

    def __init__(self, told: Callable[[dict], None] | None = None) -> None:
        self.told, self.watched = told, []

    def stage(self, rows: DataFrame, name: str, rejected: Column) -> DataFrame:
        """The rows that are not rejected; a condition that is null rejects nothing."""
        seen = Observation(name)
        no = F.coalesce(rejected, F.lit(False))
        self.watched.append((name, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(no).alias("rejected")).where(~no)

    def counts(self) -> list[dict]:
        """A dict for each stage, in order."""
        out = []
        for name, seen in self.watched:
            try:
                got = seen.get
            except Py4JJavaError as e:  # a stage that is empty without running has no row of counts
                if "toPyRow" not in str(e):
                    raise
                got = {"rows_in": 0, "rejected": 0}
            out.append({"stage": name, "rows_in": got["rows_in"], "rejected": got["rejected"], "rows_out": got["rows_in"] - got["rejected"]})
            if self.told:
                self.told(out[-1])
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(c.values()) for c in self.counts()], STAGE)
