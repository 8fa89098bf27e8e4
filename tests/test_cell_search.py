import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.index.ivf import VectorIndex
from folioflow.operators import vector


@pytest.mark.parametrize("block", [4096, 3])
def test_tasks_pass_on_their_nearest_and_nothing_is_broadcast(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr("folioflow.index.ivf.QUERY_BLOCK", block)
    x = np.random.default_rng(2).normal(size=(400, 6))
    x[7] = 0
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, x[5].tolist(), 1), (901, None, 1)], "vec_id long, embedding array<double>, label int")
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(rows, cells=12)
    queries = rows.where("vec_id % 50 = 0 OR vec_id = 7").where("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    for where in (None, F.col("label") != 0):
        want = vector.knn(rows if where is None else rows.where(where), queries, 5).orderBy("query_id", "rank").collect()
        assert index.search(queries, 5, probe=2, where=where).select("query_id", "vec_id", "distance", "rank").orderBy("query_id", "rank").collect() == want
    assert "Broadcast" not in index._met(queries, index.reach(queries), None, 5)._jdf.queryExecution().executedPlan().toString()
