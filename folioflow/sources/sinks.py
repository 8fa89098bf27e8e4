"""Writers: vectors and postings by paper, structured documents, reports, conversations, environment files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.lifecycle import replace_partition


def write_vectors(chunks: DataFrame, path: str) -> None:
    """Rows keyed ``{paper_id}_{chunk_index}``; a paper's own partition is replaced as a whole, so no stale chunks stay."""
    replace_partition(chunks.withColumn("row_id", F.concat_ws("_", "paper_id", F.col("chunk_index").cast("string"))), path)


def write_postings(chunks: DataFrame, path: str) -> None:
    """Chunks into the keyword index under ``path``: one more part of it, which takes away all chunks that its papers had before."""
    from folioflow.index.bm25 import Bm25Index

    index = Bm25Index(chunks.sparkSession, path)
    named = chunks.select("paper_id", F.concat_ws("_", "paper_id", F.col("chunk_index").cast("string")).alias("id"), "content")
    known = index.documents().select("id", F.regexp_replace("id", r"_\d+\z", "").alias("paper_id"))
    gone = known.join(named.select("paper_id").distinct(), "paper_id", "left_semi").select("id") if index.store.parts() else None
    index.put(named, "id", "content", gone)


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as flat index rows: the first anchor's places beside the chunk's own columns, nothing lost."""
    first = F.get("anchors", F.lit(0))
    return chunks.select("paper_id", "chunk_index", "content", "section_title", "has_image", *[first[c].alias(c) for c in ("anchor_id", "page", "char_start", "char_end")])


def structured(chunks: DataFrame, visuals: DataFrame) -> DataFrame:
    """One nested document for each paper: anchors, visual blocks and counts."""
    a = chunks.groupBy("paper_id").agg(F.flatten(F.collect_list("anchors")).alias("anchors"), F.count(F.lit(1)).alias("chunk_count"))
    v = visuals.groupBy("paper_id").agg(F.collect_list(F.struct(*[c for c in visuals.columns if c != "paper_id"])).alias("visual_blocks"))
    rows = a.join(v, "paper_id", "left")
    stats = F.struct("chunk_count", F.size("anchors").alias("anchor_count"), F.coalesce(F.size("visual_blocks"), F.lit(0)).alias("visual_block_count"))
    return rows.select("paper_id", "anchors", "visual_blocks", stats.alias("stats"))


def report(events: DataFrame) -> DataFrame:
    """One report for each task: its events in order."""
    return events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ts", *[c for c in events.columns if c not in ("task_id", "ts")]))).alias("events"))


def write_json(rows: DataFrame, path: str, by: str = "paper_id") -> None:
    """JSON in partitions; Spark writes aside and renames on commit, so readers never see half of it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def persist_turns(turns: DataFrame, channels: dict) -> dict[str, str]:
    """Writes finished turns by every channel (name -> function of the frame); one that fails is told and does not stop the others."""
    told = {}
    kept = turns.persist()
    for name, write in channels.items():
        try:
            write(kept)
            told[name] = "ok"
        except Exception as e:
            told[name] = f"degraded: {e}"
    kept.unpersist()
    return told


def env_text(old: str, new: dict[str, str]) -> str:
    """An environment file with new values in place, its comments and order kept; new keys follow at the end."""
    left, out = dict(new), []
    for line in old.split("\n"):
        key = line.split("=", 1)[0].strip()
        out.append(f"{key}={left.pop(key)}" if "=" in line and not line.lstrip().startswith("#") and key in left else line)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out + [f"{k}={v}" for k, v in left.items()]) + "\n"


def log_rows(rows: DataFrame, message: str = "message") -> DataFrame:
    """Log lines as JSON, with the name before the first colon as ``event``."""
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns], F.nullif(F.regexp_extract(message, r"\A([a-z_.]+):", 1), F.lit("")).alias("event"))).alias("value"))
