from pyspark.sql import functions as F

from folioflow.operators.observed import Stages


def test_stages_are_counted_by_the_job_itself(spark, tmp_path):
    calls = []
    stages = Stages(calls.append)
    rows = spark.range(100).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("id")))
    kept = stages.stage(stages.stage(rows, "odd", F.col("id") % 2 == 1), "big", F.col("x") > 50)
    jobs = spark.sparkContext.statusTracker()
    kept.write.parquet(str(tmp_path / "out"))
    before = len(jobs.getJobIdsForGroup(None))
    assert stages.counts() == calls == [{"stage": "odd", "rows_in": 100, "rejected": 50, "rows_out": 50}, {"stage": "big", "rows_in": 50, "rejected": 20, "rows_out": 30}]
    assert len(jobs.getJobIdsForGroup(None)) == before and spark.read.parquet(str(tmp_path / "out")).count() == 30
    empty = Stages()
    empty.stage(rows.limit(0), "none", F.lit(True)).write.parquet(str(tmp_path / "empty"))
    assert empty.counts() == [{"stage": "none", "rows_in": 0, "rejected": 0, "rows_out": 0}]
