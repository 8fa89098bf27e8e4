import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.index import bm25
from folioflow.index.bm25 import Bm25Index
from folioflow.index.ivf import NOWHERE, VectorIndex
from folioflow.operators import lexical, vector
from folioflow.sources.store import Conflict, Store


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def texts(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 60)) if x < 400) for _ in range(n)]


def results(df):
    return sorted((r.query_id, r.id, r.score, r.rank) for r in df.collect())


def by_scan(spark, rows, queries, k, allowed=None):
    """What a scan of all texts gives."""
    docs = docs_of(spark, rows)
    return results(lexical.bm25(lexical.postings(docs, "id"), lexical.doc_stats(docs, "id"), queries, k, allowed, "id"))


def test_changes_equal_a_rebuild(spark, tmp_path):
    rows = {f"d{i}": t for i, t in enumerate(texts(1, 150))}
    rows["empty"], rows["null"] = "", None
    queries = lexical.query_terms(spark.createDataFrame([(1, "w1 w2 w9"), (2, "w3 w3 w57"), (3, "nothing"), (4, "w1")], "q int, text string"), "q", "text")
    index = Bm25Index(spark, str(tmp_path / "i"), buckets=8)
    index.put(docs_of(spark, list(rows.items())))
    assert results(index.search(queries, 5, first=2)) == by_scan(spark, list(rows.items()), queries, 5)
    new = {"d3": "w1 w1 w1", "n1": "w57 w2", "d4": ""}
    rows |= new
    index.put(docs_of(spark, list(new.items())))
    gone = ["d7", "d8", "n1", "never"]
    index.remove(spark.createDataFrame([(x,) for x in gone], "id string"))
    rows = {k: v for k, v in rows.items() if k not in gone}
    rows["d7"] = "w9 w9 w2"
    index.put(docs_of(spark, [("d7", rows["d7"])]))
    want = by_scan(spark, list(rows.items()), queries, 5)
    fresh = Bm25Index(spark, str(tmp_path / "f"), buckets=8)
    fresh.put(docs_of(spark, list(rows.items())))
    assert results(index.search(queries, 5, first=2)) == want == results(fresh.search(queries, 5))
    stats = lambda i: sorted((r.token, r.df, round(r.idf, 9)) for r in i.term_stats().collect())
    assert stats(index) == stats(fresh) and index.size() == fresh.size()
    assert index.mean_idf() == pytest.approx(fresh.mean_idf())
    some = docs_of(spark, [(f"d{i}", None) for i in range(0, 60)]).select("id")
    assert results(index.search(queries, 5, some, first=1)) == by_scan(spark, list(rows.items()), queries, 5, some)
    index.compact()
    assert len(index.store.parts()) == 1 and results(index.search(queries, 5)) == want
    assert index.store.vacuum(1) == 4 and results(index.search(queries, 5)) == want


def test_buckets_without_a_rare_term_are_skipped(spark, tmp_path):
    rows = [(f"d{i}", f"common x{i}") for i in range(300)] + [(f"r{i}", "rare common") for i in range(3)]
    index = Bm25Index(spark, str(tmp_path / "i"), buckets=32)
    index.put(docs_of(spark, rows))
    queries = lexical.query_terms(spark.createDataFrame([(1, "rare")], "q int, text string"), "q", "text")
    assert index.bounds(queries)[0].count() <= 3
    assert results(index.search(queries, 2, first=1)) == by_scan(spark, rows, queries, 2)


def test_tasks_grow_with_the_tokens(spark, tmp_path, monkeypatch):
    """What one task counts is bounded: no file of postings holds more than its share, and terms are counted exactly without bringing them together."""
    monkeypatch.setattr(bm25, "TASK_TOKENS", 200)
    rows = [(f"d{i}", f"common same x{i} x{i} y{i % 7} " * 3) for i in range(200)] + [("null", None), ("empty", " ")]
    index = Bm25Index(spark, str(tmp_path / "i"), buckets=2)
    index.put(docs_of(spark, rows))
    path = f"{index.store.part(index.store.parts()[0])}/postings"
    files = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(files) > 10 and max(files) <= 200 and sum(files) == index.postings().count() == 800
    assert {(r.token, r.tf) for r in index.postings().where("id = 'd9'").collect()} == {("common", 3), ("same", 3), ("x9", 6), ("y2", 3)}
    assert index.term_stats().rdd.getNumPartitions() > 10
    index.remove(spark.createDataFrame([(f"d{i}",) for i in range(150)], "id string"))
    assert index.term_count() == index.term_stats().count() == 50 + 2 + 7
    index.compact()
    assert index.term_count() == index.term_stats().count() == 50 + 2 + 7


def test_an_index_of_nothing(spark, tmp_path):
    index = Bm25Index(spark, str(tmp_path / "i"))
    index.put(docs_of(spark, []))
    queries = lexical.query_terms(spark.createDataFrame([(1, "a")], "q int, text string"), "q", "text")
    assert index.size() == (0, 0.0) and index.search(queries, 3).count() == 0


def test_cells(spark, tmp_path):
    """Vectors round forty directions: under a fifth of the cells hold nearly all neighbours, and the exact search finds all without reading all."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16))
    rows = [(i, (middles[i % 40] + 0.25 * rng.normal(size=16)).tolist(), i % 3) for i in range(2000)]
    rows += [(5000, [0.0] * 16, 1), (5001, None, 1), (5002, (-middles[0]).tolist(), 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(v, cells=40)
    cells = index.cells().count()
    queries = v.where("vec_id % 100 = 0").where("vec_id <> 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    want = {(r.query_id, r.vec_id, r.rank) for r in vector.knn(v.where("embedding is not null"), queries, 10).collect()}
    exact = index.search(queries, 10, probe=3)
    assert {(r.query_id, r.vec_id, r.rank) for r in exact.collect()} == want
    probe = cells // 6
    near = {(r.query_id, r.vec_id) for r in index.search(queries, 10, probe=probe, exact=False).collect()}
    assert probe * 5 < cells and len(near & {w[:2] for w in want}) >= 0.95 * len(want)
    plan = index._met(queries, index.reach(queries).where("place <= 1"), None)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    only = index.search(queries, 10, probe=2, where=F.col("label") == 1)
    assert {(r.query_id, r.vec_id, r.rank) for r in only.collect()} == {(r.query_id, r.vec_id, r.rank) for r in vector.knn(v.where("embedding is not null"), queries, 10, [1], filter_col="label").collect()}
    zero = spark.createDataFrame([(1, [0.0] * 16)], "query_id long, query_vec array<double>")
    assert [r.vec_id for r in index.search(zero, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert index.vectors().where(F.col("cell") == NOWHERE).count() == 1


def test_a_failed_rebuild_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.rebuild(lambda p: spark.range(5).write.parquet(p))
    read = spark.read.parquet(store.part(store.parts()[0]))

    def fails(path):
        spark.range(3).write.parquet(f"{path}/one")
        raise OSError("full")

    with pytest.raises(OSError):
        store.rebuild(fails)
    assert store.latest() == 1 and spark.read.parquet(store.part(store.parts()[0])).count() == 5
    store.rebuild(lambda p: spark.range(9).write.parquet(p))
    assert read.count() == 5  # a reader across the swap keeps its files
    assert spark.read.parquet(store.part(store.parts()[0])).count() == 9
    with pytest.raises(Conflict):
        store.commit(2, [])
    store.restore(1)
    assert spark.read.parquet(store.part(store.parts()[0])).count() == 5
    copy = store.backup(str(tmp_path / "b"))
    assert copy.parts() == store.parts() and spark.read.parquet(copy.part(copy.parts()[0])).count() == 5
    assert store.backup(str(tmp_path / "b")).numbers() == [1]
    assert store.vacuum(1) == 2 and spark.read.parquet(store.part(store.parts()[0])).count() == 5
    assert Store(spark, str(tmp_path / "none")).parts() == []
