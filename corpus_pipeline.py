"""From documents to packed training sequences: five stages, each on all that the one before it kept.

1. toxicity: documents at or over the threshold of the language told from their text go.
2. near duplicates: of each component of linked documents the one with the least doc_id stays.
3. repeated passages: what an earlier document holds too is cut; documents left without a word go.
4. decontamination: spans that benchmark items cover are cut; documents covered beyond the limit go.
5. packing: what is left is packed into sequences.

A clean document passes stages 1 to 4 as it came, with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import Scratch, aside, dropped, ship, table, tidied
from folioflow.llm.decontam import decontaminate
from folioflow.llm.jaccard import one_of_each
from folioflow.llm.packing import pack_documents
from folioflow.llm.passages import cut_repeats
from folioflow.llm.toxicity import ADDED, classify


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = aside(docs, ADDED)
    return back(classify(own, table(spark, sf_dir, "labels")).where("not flagged"))


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return cut_repeats(docs)


def cut_benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_near_copy),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", cut_benchmark_spans),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; the tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        scratch = Scratch()
        docs = scratch.settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            dropped(last)
        last = docs
        tidied(spark)  # of the stage just ended
    return docs
