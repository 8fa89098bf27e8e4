import time
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioflow.streaming import progress as p


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).json(str(tmp_path / "in"))


def run(spark, df, tmp_path, mode, want):
    """The rows of the stream once there are as many as wanted; timers keep such a query alive, so it is stopped then."""
    name = f"out_{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(120):
            if q.exception() or spark.table(name).count() >= want:
                break
            time.sleep(0.5)
        assert not q.exception()
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        q.stop()


def test_progress_ends_at_the_end(spark, tmp_path):
    events = [("t", "stage", 10, 1), ("t", "completed", 100, 3), ("t", "late", 5, 4), ("u", "stage", 7, 1)]
    df = p.progress(stream(spark, tmp_path, events, "task_id string, event string, percent int, ts long"))
    assert sorted(run(spark, df, tmp_path, "append", 3)) == [("t", "completed", 100, 2), ("t", "stage", 10, 1), ("u", "stage", 7, 1)]


def test_timeout():
    class Value:
        def __init__(self):
            self.v = (2, 35, False)

        exists = lambda self: True
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    one = p.Progress(1000)
    one.state = Value()
    assert [tuple(r) for r in next(one.handleExpiredTimer(("t",), None, None)).values.tolist()] == [("t", "timeout", 35, 2)]
    assert list(one.handleExpiredTimer(("t",), None, None)) == []


def test_newest_context(spark, tmp_path):
    updates = [("s", "a", 1), ("s", "b", 2), ("r", "c", 1)]
    df = p.contexts(stream(spark, tmp_path, updates, "session_id string, content string, ts long"))
    assert sorted(run(spark, df, tmp_path, "update", 2)) == [("r", "c", 1), ("s", "b", 2)]


def test_debounce(spark):
    rows = [("k", datetime(2024, 1, 1) + timedelta(milliseconds=m), str(m)) for m in (0, 100, 200, 900)]
    got = p.debounced(spark.createDataFrame(rows, "k string, ts timestamp, v string"), "k", "ts", "v").orderBy("start").collect()
    assert [(r.n, r.last_value) for r in got] == [(3, "200"), (1, "900")]
    assert [r[0] for r in spark.createDataFrame([(10,), (90,)], "p int").select(p.polled_percent(F.col("p"))).collect()] == [18, 95]
