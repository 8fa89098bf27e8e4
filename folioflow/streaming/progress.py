"""Streams: import progress with idle timeout, newest editor context with expiry, bursts of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("completed", "failed", "done")
PROGRESS = "task_id string, event string, percent int, n_events long"
CONTEXT = "session_id string, content string, version long"


class Progress(StatefulProcessor):
    """Every event of a task with its number, and a ``timeout`` event after ``idle_ms`` without one; nothing after the end."""

    def __init__(self, idle_ms: int = 300_000) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "n long, percent int, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, percent, ended = self.state.get() if self.state.exists() else (0, 0, False)
        out = []
        for part in rows:
            for r in part.sort_values("ts").itertuples():
                if ended:
                    continue
                n, percent = n + 1, int(r.percent)
                ended = r.event in TERMINAL
                out.append((key[0], r.event, percent, n))
        self.state.update((n, percent, ended))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not ended:
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["task_id", "event", "percent", "n_events"])

    def handleExpiredTimer(self, key: tuple, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, percent, ended = self.state.get() if self.state.exists() else (0, 0, False)
        if ended:
            return
        self.state.update((n, percent, True))
        yield pd.DataFrame([(key[0], "timeout", percent, n)], columns=["task_id", "event", "percent", "n_events"])

    def close(self) -> None:
        pass


def progress(events: DataFrame, idle_ms: int = 300_000) -> DataFrame:
    """Stream of events (task_id, event, percent, ts) as a stream of progress; wants the RocksDB state store."""
    return events.groupBy("task_id").transformWithStateInPandas(Progress(idle_ms), PROGRESS, "Append", "ProcessingTime")


class Context(StatefulProcessor):
    """The newest context of each session, forgotten ``ttl_ms`` after its last change."""

    def __init__(self, ttl_ms: int = 300_000) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("context", "content string, version long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        content, version = self.state.get() if self.state.exists() else (None, 0)
        for part in rows:
            for r in part.sort_values("ts").itertuples():
                content, version = r.content, version + 1
        self.state.update((content, version))
        yield pd.DataFrame([(key[0], content, version)], columns=["session_id", "content", "version"])

    def close(self) -> None:
        pass


def contexts(updates: DataFrame, ttl_ms: int = 300_000) -> DataFrame:
    """Stream of updates (session_id, content, ts) as a stream of the newest context of each session."""
    return updates.groupBy("session_id").transformWithStateInPandas(Context(ttl_ms), CONTEXT, "Update", "ProcessingTime")


def debounced(events: DataFrame, key: str, ts: str, value: str, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst of events without a longer gap: when it began and ended, how many, and the last value. Batch or stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.max_by(value, ts).alias("last_value")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "last_value")


def bounded_window(messages: DataFrame, n: int) -> DataFrame:
    """Batch equivalent of a bounded window of messages per session."""
    from folioflow.operators.fusion import last_messages

    return last_messages(messages, n)


def polled_percent(percent, most: int = 95, step: int = 8):
    """What a client shows while it polls without news."""
    return F.least(percent + step, F.lit(most))
