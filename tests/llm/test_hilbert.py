from pyspark.sql import functions as F

from folioflow.llm import hilbert


def test_curve_visits_every_cell_by_single_steps(spark):
    cells = spark.range(1 << 8).select(*[F.shiftright("id", 2 * k).bitwiseAND(F.lit(3)).cast("int").alias(f"c{k}") for k in range(4)])
    rows = cells.select("*", hilbert.hilbert_index([F.col(f"c{k}") for k in range(4)], bits=2).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(256))
    assert all(sum(abs(a[k] - b[k]) for k in range(4)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark):
    rows = [(i, f"text {i % 7}", "en" if i % 3 else None, f"s{i % 5}", i * 10 if i % 4 else None) for i in range(1000)] + [(5, "again", "en", "s", 1)] * 30 + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = hilbert.shard_documents(df).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = hilbert.shard_documents(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert got[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()
    few = hilbert.shard_documents(df.limit(3)).toPandas()
    assert sorted(few.slot) == [0, 0, 0]
    assert hilbert.shard_documents(df.limit(0)).count() == 0


def test_runs_prune(spark):
    df = spark.createDataFrame([(i, "x", ["en", "fr"][i % 2], f"s{i % 8}", i % 100) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    sharded = hilbert.shard_documents(df)
    spread = sharded.groupBy("shard").agg(F.countDistinct("lang").alias("l"), F.countDistinct("source").alias("s")).agg(F.avg("l"), F.avg("s")).first()
    assert spread[0] < 2 and spread[1] < 6
    assert hilbert.manifest(sharded, ["doc_id"]).agg(F.sum("rows")).first()[0] == 4000
