"""Whole flows: cleaning chains, ingest of files to indexes, and answering a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import folds, rules, text
from folioflow.index.bm25 import Bm25Index
from folioflow.operators import answer, fusion, lexical, library, segment, vector
from folioflow.operators.metrics import cleaning_stats
from folioflow.sources import connectors, sinks, store


def clean_paper(c: Column | str) -> Column:
    """The chain for parsed papers in Chinese and English; the order of its steps matters.

    All pattern steps are one expression; only tables of contents, pseudo-tables, headings and URLs go through Python, in one Arrow batch.
    """
    t = text.filter_lines(c, rules.ZH_LINE_RULES + rules.EN_LINE_RULES)
    t = text.substitute(t, [*rules.ZH_REGEX_RULES, rules.HTML_TABLE_TAGS])
    t = text.join_spaced_headings(t)
    t = folds.on_column(lambda x: folds.flatten_tables(folds.drop_toc(x)))(t)
    t = text.compress_newlines(text.join_cjk_in_headings(text.join_cjk(t)))
    t = folds.on_column(lambda x: folds.join_urls(folds.level_headings(x)))(t)
    return text.rstrip_lines(t)


def clean_generic(c: Column | str) -> Column:
    """The chain for any markdown."""
    t = text.substitute(c, rules.GENERIC_REGEX_RULES)
    t = text.compress_newlines(text.narrow_width(folds.on_column(folds.flatten_tables)(t)))
    t = folds.on_column(lambda x: folds.join_ultra_short_lines(folds.join_broken_lines(x)))(t)
    t = text.rstrip_lines(text.compress_newlines(t))
    return folds.on_column(folds.level_headings)(t)


def cleaned(docs: DataFrame, paper: bool = True, column: str = "text") -> DataFrame:
    """docs with the cleaned text, its lengths and how much went."""
    out = docs.withColumn("_before", F.col(column)).withColumn(column, (clean_paper if paper else clean_generic)(column))
    return out.withColumns(cleaning_stats(F.col("_before"), F.col(column))).drop("_before")


def ingest(files: DataFrame, parser: connectors.Parser, embedder: connectors.Embedder, out: str) -> DataFrame:
    """Files (path, content, page_count) to chunks with vectors under ``out``: vectors and postings by paper. Returns the import report.

    Each stage is one plan; what fails to parse or is too long for the embedder is told in the report, and the rest goes on.
    """
    parsed = connectors.parsed(files, parser).withColumn("paper_id", text.paper_id("path"))
    docs = parsed.withColumn("text", clean_paper("markdown"))
    chunks = segment.chunks(docs.select("paper_id", "text"), "paper_id")
    vectors = connectors.embedded(chunks, embedder)
    sinks.write_vectors(vectors, f"{out}/vectors")
    sinks.write_postings(chunks, f"{out}/postings")
    stored = files.sparkSession.read.parquet(f"{out}/vectors")
    per_paper = stored.groupBy("paper_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("too_long").alias("too_long"))
    status = F.when(F.col("failed") == F.col("parts"), "failed").when((F.col("failed") > 0) | (F.coalesce("too_long", F.lit(0)) > 0), "degraded").otherwise("ok")
    return parsed.join(per_paper, "paper_id", "left").select("paper_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), "parts", "failed", status.alias("status"))


def leg(find: Callable[[], DataFrame], empty: str) -> tuple[DataFrame, str | None]:
    """A leg's rows, found and written, and no error; or no rows of the schema ``empty`` and what went wrong, so that a search goes on with the other leg."""
    try:
        return store.stored(find(), "leg"), None
    except Exception as e:
        return SparkSession.active().createDataFrame([], empty), f"{type(e).__name__}: {str(e).strip().splitlines()[-1] if str(e).strip() else ''}"


def search(spark: SparkSession, index: str, questions: DataFrame, embedder: connectors.Embedder, gone: DataFrame | None = None, k: int = 20, final: int = 10, failed: dict | None = None) -> DataFrame:
    """Questions (query_id, text) against an index from ingest: both legs, fused, with contents. Papers in ``gone`` (paper_id) are left out of results, not of statistics.

    A leg that fails counts as one that found nothing; ``failed`` is told its name and error. Where both fail, nothing is found.
    """
    chunks = spark.read.parquet(f"{index}/vectors")
    live = chunks if gone is None else chunks.join(gone.select("paper_id").distinct(), "paper_id", "left_anti")

    def by_vector() -> DataFrame:
        asked = connectors.embedded(questions, embedder, "text").select("query_id", F.col("embedding").alias("query_vec"))
        return vector.knn(live, asked, k, id_col="row_id")

    def by_words() -> DataFrame:
        terms = lexical.query_terms(questions, "query_id", "text")
        found = Bm25Index(spark, f"{index}/postings").search(terms, k, None if gone is None else live.select(F.col("row_id").alias("id")))
        return found.withColumnRenamed("id", "row_id")

    query_id = questions.schema["query_id"].dataType.simpleString()
    dense, wrong = leg(by_vector, f"query_id {query_id}, row_id string, distance double, rank int")
    sparse, other = leg(by_words, f"query_id {query_id}, row_id string, score double, rank int")
    if failed is not None:
        failed |= {name: e for name, e in (("dense", wrong), ("sparse", other)) if e}
    fused = fusion.rrf(dense, sparse, final, "row_id")
    return fusion.with_content(fused, chunks.select("row_id", "paper_id", "chunk_index", "section_title", "content"), "row_id")


def answered(results: DataFrame, questions: DataFrame, model: connectors.TextModel, budget: int = fusion.BUDGET) -> DataFrame:
    """Questions with context, answer, sources and typed blocks. Questions without results are answered without context."""
    packed = questions.join(fusion.pack_context(results, budget), "query_id", "left")
    cards = answer.source_cards(results.withColumnRenamed("chunk_index", "chunk_id")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "content"))).alias("sources"))

    @F.pandas_udf("string")
    def ask(prompts):
        return prompts.map(lambda p: connectors.tried(lambda: model.chat([{"role": "user", "content": p}]), base=0.0))

    prompt = F.concat_ws("\n\n", F.col("context"), F.col("text"))
    out = packed.join(cards, "query_id", "left").withColumns({"answer": ask(prompt), "source_ids": F.coalesce(F.transform("sources", lambda s: s["source_id"]), F.array().cast("array<string>"))})
    return answer.blocks(out, "answer", "source_ids")


def papers(items: DataFrame, title: str | None = None, authors: str | None = None, year_from: int | None = None, year_to: int | None = None, mode: str = "time") -> DataFrame:
    """The library as a client lists it."""
    return library.ordered(library.filtered(items, title, authors, year_from, year_to), mode)
