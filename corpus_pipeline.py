"""From raw documents to packed token sequences: the stages of a training corpus, each an operator of rastra.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastra.llm.line_dedup import without_repeated_lines
from rastra.llm.near_dedup import keep_one_of_each
from rastra.llm.packing import best_fit_pack
from rastra.llm.pii import mask_personal_data
from rastra.llm.toxicity import without_toxic
from rastra.storage import stage_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Less the documents that the severity model rejects. Null and empty texts stay; repeated rows are judged alike; an empty
    table stays empty; other columns pass through."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document has. Null texts stay null; a text that loses all its lines stays as an empty one;
    rows that repeat a doc_id are one document; rows without one come last."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id. Texts without words and rows without a doc_id all stay."""
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data masked by its kind. Null texts stay null; nothing else changes."""
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences. A null or empty text is one piece, the end token; very long texts are as
    many pieces as they need; repeated rows are packed as often as they stand."""
    return best_fit_pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Training, iterative components and byte-pair merges have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep. Every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
