"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. Stages but the last
return the columns of their docs. No stage can be expressed in SQL, so
ORACLE_SQL is None and tests/llm compares the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import bounded_batches, cut, table
from corvane.llm.exact_dedup import keep_first
from corvane.llm.language_id import keep_identified
from corvane.llm.mixing import mix
from corvane.llm.near_dedup import keep_one_of_each
from corvane.llm.packing import pack
from corvane.llm.queries import tokenizer_path

#: Bytes of an Arrow batch: executors that have run several stages hold more than those of one operator.
BATCH = 2 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; letterless ones and those unlike any language go."""
    bounded_batches(spark, BATCH)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    bounded_batches(spark, BATCH)
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate classes, the document with the smallest id."""
    bounded_batches(spark, BATCH)
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence."""
    bounded_batches(spark, BATCH)
    return pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
