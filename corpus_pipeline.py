"""From raw documents to packed sequences: quality rules, line and near-duplicate removal, mixing, packing.

Each stage works on everything its predecessor kept and is written as Parquet before the next begins, so lost executors
cost at most the stage at hand. The stages' own modules say what they do with nulls, ties and repeated rows; together: a null
or empty text fails the quality rules and goes, a null doc_id is a document of its own, repeated rows go together where a
stage decides by doc_id, and columns beyond those of documents are carried up to the packing. An empty table gives no
pieces. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyveil.llm import line_dedup, lsh_forest, mixing, packing, quality, queries
from tallyveil.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsh_forest.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, queries.SOURCE_SHARES, queries.LANG_SHARES, queries.TOPIC_SHARES)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"), 2, keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near-duplicates", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # n-gram model, raking and tokenizer are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage: the pieces of the documents that are left, with their sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
