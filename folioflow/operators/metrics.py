"""Latency, soak, progress and health figures of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The shares of an import's stages in its progress, in their order.
STAGE_WEIGHTS = {"transforming": 25, "vlm_enriching": 10, "cleaning": 10, "chunking": 15, "embedding": 20, "indexing": 20}


def _micros(start: Column | str, end: Column | str) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def latency_stats(rows: DataFrame, operation: str = "operation", duration: str = "duration_ms", success: str = "success") -> DataFrame:
    """Per operation count, avg, p50, p95, p99 and success_rate; a percentile q is the value at place int(n * q) of the sorted values.

    Values are counted before they are sorted, so that an operation's rows need not meet in one task.
    """
    counts = rows.groupBy(operation, duration).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(success).cast("long")).alias("_ok"))
    by = Window.partitionBy(operation)
    upto = F.sum("_n").over(by.orderBy(duration).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"_upto": upto, "_total": F.sum("_n").over(by)})
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.col("_total") * q), F.col(duration)))
    return counts.groupBy(operation).agg(
        F.sum("_n").alias("count"), (F.sum(F.col(duration) * F.col("_n")) / F.sum("_n")).alias("avg_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"),
        (F.sum("_ok") / F.sum("_n")).alias("success_rate"),
    )


def recent(rows: DataFrame, ts: str, as_of: Column, seconds: int = 3600) -> DataFrame:
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(secs=F.lit(seconds)))


def soak_stats(rows: DataFrame, by: list[str], time: str = "response_ms", success: str = "success") -> DataFrame:
    """Mean, median, p95 and p99 (linear between values), maximum of the positive times, and the share of successes."""
    positive = F.when(F.col(time) > 0, F.col(time))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(positive).alias("mean_ms"), F.percentile(positive, 0.5).alias("median_ms"), F.percentile(positive, 0.95).alias("p95_ms"),
        F.percentile(positive, 0.99).alias("p99_ms"), F.max(positive).alias("max_ms"), F.avg(F.col(success).cast("double")).alias("success_rate"),
    )


def error_histogram(rows: DataFrame, message: str = "message") -> DataFrame:
    return rows.groupBy(F.substring(message, 1, 100).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def stage_durations(events: DataFrame) -> DataFrame:
    """(task_id, stage, started, ended, seconds, status) from start, complete, fail and degrade events; a stage without an end is running."""
    end = F.col("event").isin("complete", "fail", "degrade")
    rows = events.groupBy("task_id", "stage").agg(F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("started"), F.max(F.when(end, F.col("ts"))).alias("ended"), F.max_by(F.when(end, F.col("event")), F.when(end, F.col("ts"))).alias("_end"))
    status = F.when(F.col("_end") == "complete", "completed").when(F.col("_end") == "fail", "failed").when(F.col("_end") == "degrade", "degraded").otherwise("running")
    return rows.select("task_id", "stage", "started", "ended", (_micros("started", "ended")).alias("micros"), status.alias("status"))


def task_status(stages: DataFrame) -> DataFrame:
    """Per task: failed if a stage failed, degraded if one did, else completed; and how long it took."""
    s = F.col("status")
    status = F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "degraded"), "degraded").otherwise("completed")
    return stages.groupBy("task_id").agg(status.alias("status"), _micros(F.min("started"), F.max("ended")).alias("micros"))


def progress_percent(stage: Column, event: Column, done: Column, total: Column) -> Column:
    """The shares of the stages before, and of this one: nothing when started, all when completed, half when failed, a part in between; -1 for a failed import."""
    base, own, before = F.lit(0), F.lit(0), 0
    for name, weight in STAGE_WEIGHTS.items():
        base, own, before = F.when(stage == name, before).otherwise(base), F.when(stage == name, weight).otherwise(own), before + weight
    part = F.when(total > 0, F.floor(own * done / total)).otherwise(0)
    return F.when(event == "pipeline.completed", 100).when(event == "pipeline.failed", -1).when(event.endswith(".started"), base).when(event.endswith(".completed"), base + own).when(event.endswith(".failed"), base + F.floor(own / 2)).otherwise(base + F.coalesce(part, F.lit(0))).cast("int")


def health(rows: DataFrame, status: str = "status") -> DataFrame:
    s = F.col(status)
    return rows.agg(F.when(F.bool_or(s == "error"), "error").when(F.bool_or(s != "ok"), "degraded").otherwise("ok").alias("overall"))


def import_summary(rows: DataFrame) -> DataFrame:
    """How many imports ended how, and the chunks of the good ones."""
    n = lambda v: F.count_if(F.col("status") == v).alias(v)
    return rows.agg(n("ok"), n("skipped"), n("failed"), n("error"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("chunks"))), F.lit(0)).alias("chunks"))


def failure_runs(rows: DataFrame, group: str, order: str, failed: Column) -> DataFrame:
    """(group, first, last, length) of each unbroken run of failures."""
    by = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("_f", failed).withColumn("_run", F.sum((~F.col("_f")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("_f").groupBy(group, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def should_stop(rows: DataFrame, group: str, order: str, failed: Column, most: int = 10, least_rate: float = 0.95) -> DataFrame:
    """Per group whether ``most`` failures came in a row, or after ten requests too few succeeded."""
    longest = failure_runs(rows, group, order, failed).groupBy(group).agg(F.max("length").alias("longest"))
    rates = rows.groupBy(group).agg(F.count(F.lit(1)).alias("requests"), F.avg((~failed).cast("double")).alias("success_rate"))
    out = rates.join(longest, group, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))
    return out.withColumn("stop", (F.col("longest") >= most) | ((F.col("requests") >= 10) & (F.col("success_rate") < least_rate)))


def storage_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.countDistinct("paper_id").alias("documents"), F.round(F.sum("length") / 1048576, 6).alias("size_mb"))


def cleaning_stats(before: Column, after: Column) -> dict[str, Column]:
    n, m = F.length(before), F.length(after)
    return {"original_length": n, "cleaned_length": m, "reduction_ratio": F.when(n > 0, F.round(1 - m / n, 3)).otherwise(F.lit(0.0))}


def soak_rates(responses: DataFrame, group: str, ts: str, value: Column, high: Column) -> DataFrame:
    """Per group the responses, the mean of a value, the share of responses with a property, and responses a minute between the first and the last."""
    seconds = F.greatest(F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp")), F.lit(1_000_000)) / 1e6
    n = F.count(F.lit(1))
    return responses.groupBy(group).agg(n.alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.count_if(high) / n, 6).alias("high_rate"), F.round(n * 60 / seconds, 6).alias("per_minute"))
