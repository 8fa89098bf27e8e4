from datetime import datetime, timedelta

import duckdb
import pytest

from folioflow.plans import stream_queries  # noqa: F401
from folioflow.plans.registry import ORACLES, QUERIES

NAN = float("nan")
#: (user, type, value) in the order of time: tasks without an end, whose percent is no whole number, and odd rows.
ROWS = [
    *[(1, "view", 12.5), (1, "click", 20.0), (1, "signup", 3.0)],
    *[(2, "signup", 49.0), (2, "error", 25.0), (2, "view", 25.0), (2, "purchase", 40.0)],
    *[(3, "view", -7.0), (3, "click", -90.0), (3, "view", None)],
    *[(4, "completed", 50.0), (4, "failed", 50.0), (4, "click", 50.0)],
    *[(5, "view", NAN), (5, None, 1.0)],
    *[(None, "purchase", 50.0), (None, "signup", 50.0), (None, "error", 8.0)],
    *[(6, "view", 50.0), (6, "purchase", 41.0), (6, "click", 9.0)],
    *[(7, "error", 25.0), (7, "error", None), (7, "refund", None)],
    (8, "view", 37.5),
]


@pytest.mark.parametrize("name", ["stream_progress", "stream_session_window", "stream_context_ttl"])
def test_streams_give_the_rows_of_their_sql(spark, tmp_path, name):
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), u, kind, value, f"p{i}") for i, (u, kind, value) in enumerate(ROWS) if name == "stream_progress" or kind]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_rows_are_reduced_before_they_meet_state():
    import pandas as pd

    from folioflow.streaming.stateful import _newest_of_each

    rows = pd.DataFrame({"session_id": 1, "_none": False, "seq": range(6), "ts": [3, 2, 1, 9, 5, 4], "name": ["a", "a", "a", "b", "x", "y"], "value": 1.0, "n": 1})
    got = pd.concat(_newest_of_each(("a", "b"))(iter([rows[:3], rows[3:]])))
    assert sorted((str(r.name), r.seq, r.n) for r in got.itertuples(index=False)) == [("None", 4, 2), ("a", 0, 3), ("b", 3, 1)]
