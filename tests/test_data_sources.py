import sqlite3

import pytest
from pyspark.sql import functions as F

from folioflow.sources.relational import SqliteReader, SqliteSource
from folioflow.streaming import polling, stateful


@pytest.fixture
def library(tmp_path):
    path = tmp_path / "library.db"
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE items (item_id INTEGER PRIMARY KEY, title TEXT, "year of" INT, score REAL, raw BLOB, anything)')
    con.executemany("INSERT INTO items VALUES (?, ?, ?, ?, ?, ?)", [(i, f"title {i}", 1990 + i % 30, i / 2, bytes([i % 256]), i) for i in range(5000)])
    con.execute("INSERT INTO items VALUES (9000, NULL, 'not a year', 'x', NULL, NULL), (9001, 'it''s', NULL, 2, x'00', 'é')")
    con.execute("CREATE TABLE empty (a INT)")
    con.commit()
    con.close()
    return str(path)


def rows_of(spark, path, name):
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").option("path", path).option("table", name).load()


def test_a_table_is_read_by_row_ids(spark, library):
    df = rows_of(spark, library, "items")
    assert df.schema.simpleString() == "struct<item_id:bigint,title:string,year of:bigint,score:double,raw:binary,anything:string>"
    assert df.rdd.getNumPartitions() > 1
    assert df.count() == 5002 and df.agg(F.sum("item_id")).first()[0] == sum(range(5000)) + 18001
    odd = {r.item_id: r for r in df.where("item_id >= 9000").collect()}
    assert (odd[9000].title, odd[9000]["year of"], odd[9000].score) == (None, None, None)
    assert (odd[9001].title, bytes(odd[9001].raw), odd[9001].anything) == ("it's", b"\0", "é")
    assert rows_of(spark, library, "empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        rows_of(spark, library, "nothing").count()


@pytest.mark.parametrize(
    ("condition", "want"),
    [("`year of` = 1995", 167), ("`year of` > 2017", 332), ("title = 'it\\'s'", 1), ("title IN ('title 3', 'title 4', 'none')", 2), ("contains(title, '99')", 95), ("title IS NULL", 1), ("`year of` IS NOT NULL", 5000), ("score >= 2499.5", 1), ("item_id <= 2 AND title > 'title 0'", 2), ("`year of` = 1995 OR item_id = 1", 168)],
)
def test_filters_give_what_spark_gives(spark, library, condition, want):
    df = rows_of(spark, library, "items")
    assert df.where(condition).count() == want


def test_filters_reach_the_file(library):
    from pyspark.sql import datasource as ds
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("item_id", LongType()), StructField("title", StringType()), StructField("score", DoubleType())])
    reader = SqliteReader({"path": library, "table": "items"}, schema)
    left = list(reader.pushFilters([ds.EqualTo(("item_id",), 7), ds.GreaterThan(("score",), 1.0), ds.StringContains(("title",), "7")]))
    assert left == [ds.GreaterThan(("score",), 1.0)] and '"item_id" = ?' in reader.sql()
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1


def test_each_event_comes_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(polling.TaskLogs)
    logs = tmp_path / "logs"
    logs.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.format("task_logs").option("path", str(logs)).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for i in range(5):
        polling.told("a", str(logs), {"n": i})
    polling.told("b", str(logs), {"n": 0, "text": "zwei Wörter"})
    with (logs / "a.jsonl").open("a") as f:
        f.write('{"n": 5')  # a line that is still being written
    run()
    assert spark.read.parquet(out).count() == 6
    with (logs / "a.jsonl").open("a") as f:
        f.write("}\n")
    polling.told("c", str(logs), {"n": 0})
    run()
    run()
    got = [(r.task_id, r.n) for r in spark.read.parquet(out).select("task_id", F.get_json_object("value", "$.n").cast("int").alias("n")).collect()]
    assert sorted(got) == [("a", i) for i in range(6)] + [("b", 0), ("c", 0)]


def rows_in_batches(spark, folder, parts, schema):
    """A stream that brings each part as a batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        next(p for p in folder.glob("*.parquet") if not p.name.startswith("b")).rename(folder / f"b{i}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_windows_keep_the_last_messages_over_batches(spark, tmp_path):
    parts = [[(1, 1, 10, "a"), (1, 2, 20, "b"), (2, 1, 5, "x")], [(1, 4, 40, "d"), (1, 3, 30, "c")], [(1, 5, 50, "e")]]
    stream = rows_in_batches(spark, tmp_path / "in", parts, "session_id long, seq long, ts long, content string")
    told = stateful.caught_up(stateful.session_windows(stream, 3), "test-window").collect()
    windows = {}
    for r in sorted(told, key=lambda r: r.place):
        windows.setdefault((r.session_id, r.version), []).append(r.content)
    assert windows == {(1, 2): ["a", "b"], (1, 4): ["b", "c", "d"], (1, 5): ["c", "d", "e"], (2, 1): ["x"]}


def test_percent_comes_from_stages(spark, tmp_path):
    parts = [[(1, 1, 1, "parse", 0.5), (1, 2, 2, "other", 1.0)], [(1, 3, 3, "parse", 0.2), (1, 4, 4, "index", 1.0), (2, 1, 1, "failed", 0.0)], [(1, 5, 5, "completed", 0.0), (1, 6, 6, "parse", 1.0), (2, 2, 2, "parse", 1.0)]]
    stream = rows_in_batches(spark, tmp_path / "in", parts, "task_id long, seq long, ts long, stage string, fraction double")
    told = stateful.caught_up(stateful.stage_percent(stream, {"parse": 60, "index": 40}), "test-stages").collect()
    assert sorted(tuple(r) for r in told) == [(1, 2, 30, ""), (1, 4, 70, ""), (1, 5, 100, "completed"), (2, 1, 0, "failed"), (2, 1, 0, "failed")]


def test_newest_values_and_their_fallback(spark, tmp_path):
    parts = [[(1, 1, 100, "a", 1.0), (1, 2, 200, "a", 2.0)], [(1, 3, 150, "a", 9.0), (1, 4, 300, "b", 3.0)]]
    stream = rows_in_batches(spark, tmp_path / "in", parts, "session_id long, seq long, ts long, name string, value double").withColumn("ts", F.timestamp_seconds("ts"))
    told = stateful.caught_up(stateful.newest_values(stream, ("a", "b"), -1.0), "test-newest").collect()
    assert sorted((r.version, r.name, r.value, r.told) for r in told) == [(2, "a", 2.0, True), (2, "b", -1.0, False), (4, "a", 2.0, True), (4, "b", 3.0, True)]
