"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table


def op1_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.mincut import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.hilbert import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.toxicity import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "lang_told", "flagged")


def op5_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.passages import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.quality import assess

    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.decontam import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.ogg import media_column

    got = media_column(table(spark, sf_dir, "documents"))
    n = F.octet_length("payload").cast("long")
    tail = F.expr("substring(payload, octet_length(payload) - 63, 64)")
    return got.select("doc_id", "n_bytes", n.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op10_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_va_file_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.vafile import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
