"""A source that polls the event logs of tasks: one file of JSON lines for each task, which only grows.

    spark.dataSource.register(TaskLogs)
    spark.readStream.format("task_logs").option("path", folder).load()

An offset says for each task up to which byte its log was read, and only whole lines count. Logs stay, so any range can be read again
after a restart, and Spark's checkpoint says which ranges are done: every line comes once. How often the folder is looked at is the query's trigger; ``POLL`` is the usual one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import datasource as ds

POLL = "2 seconds"
SCHEMA = "task_id string, seq long, value string"
SUFFIX = ".jsonl"


@dataclass
class Stretch(ds.InputPartition):
    """Bytes of a task's log, from a line's start to a line's end."""

    task: str
    start: int
    end: int


def _whole(path: Path, at: int) -> int:
    """Up to where the log's lines are complete, looked for backwards from its end, no further than ``at``."""
    size = path.stat().st_size
    with path.open("rb") as f:
        end = size
        while end > at:
            start = max(at, end - 65536)
            f.seek(start)
            cut = f.read(end - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return at


class TaskLogs(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "task_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TaskLogReader:  # noqa: N802
        return TaskLogReader(self.options["path"])


class TaskLogReader(ds.DataSourceStreamReader):
    """Rows (task_id, seq, value): a line and the byte at which it starts, which orders a task's lines. A log that has shrunk is not read on."""

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file:")
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        for log in sorted(Path(self.path).glob(f"*{SUFFIX}")):
            self.seen[log.stem] = _whole(log, self.seen.get(log.stem, 0))
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        for task, at in end.items():  # after a restart what was read before is known from the offsets
            self.seen[task] = max(at, self.seen.get(task, 0))
        return [Stretch(t, start.get(t, 0), e) for t, e in end.items() if e > start.get(t, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        with (Path(self.path) / f"{partition.task}{SUFFIX}").open("rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                yield partition.task, at, line.decode("utf-8", "replace").rstrip("\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def told(task: str, folder: str, event: dict) -> None:
    """Adds one event to a task's log."""
    with (Path(folder) / f"{task}{SUFFIX}").open("a", encoding="utf-8") as f:
        f.write(json.dumps(event, ensure_ascii=False) + "\n")
