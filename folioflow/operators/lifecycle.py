"""Upserts, deletes, retention and renames as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of both, of each key the newest: by ``version``, or new over old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("_new")] if version is None else [F.desc(version), F.desc("_new")]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r", "_new")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def mark_deleted(items: DataFrame, ids: list, at: Column) -> DataFrame:
    return items.withColumn("deleted_at", F.when(F.col("item_id").isin(ids), F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at")))


def restore(items: DataFrame, ids: list) -> DataFrame:
    return items.withColumn("deleted_at", F.when(~F.col("item_id").isin(ids), F.col("deleted_at")))


def expired(tombstones: DataFrame, now: float, days: float) -> DataFrame:
    """Tombstones (deleted_at in epoch seconds) older than the retention time."""
    return tombstones.where(F.lit(now) - F.col("deleted_at") > days * 86400)


def sweep(tombstones: DataFrame, vectors: DataFrame, postings: DataFrame, now: float, days: float, key: str = "paper_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tombstones, vectors, postings) without what has expired; written together, so a tombstone goes only with its rows."""
    gone = expired(tombstones, now, days).select(key).distinct()
    return without(tombstones, gone, key), without(vectors, gone, key), without(postings, gone, key)


def rename(rows: DataFrame, old: str, new: str, id_col: str = "chunk_id", key: str = "paper_id") -> DataFrame:
    """Rows of one paper under another name, in key and ids."""
    mine = F.col(key) == old
    return rows.withColumns({id_col: F.when(mine, F.concat(F.lit(new), F.substr(F.col(id_col), F.lit(len(old) + 1)))).otherwise(F.col(id_col)), key: F.when(mine, F.lit(new)).otherwise(F.col(key))})


def update_status(tasks: DataFrame, task_id: str, status: str, message: str | None, now: Column, paper_id: str | None = None) -> DataFrame:
    """One task with a new status; the terminal ones stamp ``completed_at``, and nothing given leaves message and paper as they are."""
    mine = F.col("task_id") == task_id
    new = {"status": F.lit(status)}
    if message is not None:
        new["message"] = F.lit(message)
    if paper_id is not None:
        new["paper_id"] = F.lit(paper_id)
    if status in ("done", "completed", "failed", "error"):
        new["completed_at"] = now
    return tasks.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()})


def replace_partition(rows: DataFrame, path: str, key: str = "paper_id") -> None:
    """Writes papers over their own partitions only, all at once on commit."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def overlay(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the last value of every column that is not null."""
    rest = [c for c in updates.columns if c not in (key, order)]
    return updates.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def renamed_session(sessions: DataFrame, session_id: str, title: str, now: Column) -> DataFrame:
    """Sessions with the one's title and time of change; a blank title changes nothing."""
    hit = (F.col("session_id") == session_id) & F.lit(bool(title.strip()))
    return sessions.withColumns({"title": F.when(hit, F.lit(title.strip())).otherwise(F.col("title")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def without_sessions(gone: DataFrame, *tables: DataFrame, key: str = "session_id") -> list[DataFrame]:
    """Each of the tables (sessions, messages, whatever hangs on them) without the rows of sessions that are gone."""
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in tables]


def distinct_in_order(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """(group, values): a group's distinct values in the order of their first rows. Values are made distinct before a group's meet; null ones are left out."""
    first = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(F.struct(*order)).alias("_first"))
    per = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_first", value))).alias("_v"))
    return per.select(group, F.transform("_v", lambda x: x[value]).alias("values"))
