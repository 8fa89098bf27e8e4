"""Directories that change by versions: numbered manifests, each naming the parts that make up one state.

A part is written in full before a manifest names it, and a manifest appears by one rename that fails where its number is taken. So
a failed writer leaves the old state, a reader keeps the parts that it has opened, and of two writers at once one is told to begin anew.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, on one machine only, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_one = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_one.isDefined():
            return set_one.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once in the shared folder and read back; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows, else as it is."""
    from pyspark.sql import functions as F

    from folioflow.operators.sized import is_small

    return F.broadcast(df) if is_small(df, rows) else df


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


class Conflict(RuntimeError):
    """Another writer has committed this number first."""


class Store:
    """Versions of one directory. A state is a list of part names, in the order in which they came."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str = "") -> tuple:
        return _file_system(self.spark, f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        fs, where = self._fs("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def parts(self, number: int | None = None) -> list[str]:
        """The parts of a state, the latest one if no number is given; none where nothing was committed yet."""
        if number is None:
            known = self.numbers()
            if not known:
                return []
            number = known[-1]
        fs, where = self._fs(f"manifests/{number:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def part(self, name: str) -> str:
        return f"{self.path}/parts/{name}"

    def latest(self) -> int:
        return (self.numbers() or [0])[-1]

    def commit(self, number: int, parts: list[str]) -> None:
        """Makes the parts state ``number``: written aside, then renamed, which fails if that state is there already."""
        fs, aside = self._fs(f"manifests/.{uuid.uuid4().hex}.json")
        fs.mkdirs(aside.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        jvm = self.spark._jvm
        to = self._fs(f"manifests/{number:012d}.json")[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(aside).toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(to), plain)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(to):
                raise Conflict(f"state {number} of {self.path} was committed by another writer") from e
            raise

    def append(self, write: Callable[[str], None]) -> str:
        """A new part, written by the function into the path that it gets, after those of the latest state."""
        number, name = self.latest(), uuid.uuid4().hex
        before = self.parts(number) if number else []
        write(self.part(name))
        self.commit(number + 1, [*before, name])
        return name

    def rebuild(self, write: Callable[[str], None]) -> str:
        """A new state of one new part. Older states stay until vacuum()."""
        number, name = self.latest(), uuid.uuid4().hex
        write(self.part(name))
        self.commit(number + 1, [name])
        return name

    def restore(self, number: int) -> None:
        """The parts of an older state as the latest one."""
        self.commit(self.latest() + 1, self.parts(number))

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last ``keep`` states and the parts that no kept state names; how many parts went. Nobody may be writing meanwhile."""
        known = self.numbers()
        kept = known[-keep:]
        live = {p for n in kept for p in self.parts(n)}
        for n in set(known) - set(kept):
            fs, where = self._fs(f"manifests/{n:012d}.json")
            fs.delete(where, False)
        fs, where = self._fs("parts")
        dead = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in live] if fs.exists(where) else []
        for p in dead:
            fs.delete(p, True)
        return len(dead)

    def backup(self, to: str) -> Store:
        """A copy of the latest state in another directory, or in one that has it already the same: parts that are there are not copied again."""
        other = Store(self.spark, to)
        number, names = self.latest(), self.parts()
        for name in names:
            fs, there = other._fs(f"parts/{name}")
            if not fs.exists(there):
                aside = other._fs(f"parts/.{name}")[1]
                source_fs, source = self._fs(f"parts/{name}")
                self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, source, fs, aside, False, True, self.spark._jsparkSession.sessionState().newHadoopConf())
                fs.rename(aside, there)
        if number and (not other.numbers() or other.parts() != names):
            other.commit(other.latest() + 1, names)
        return other
