"""A training corpus from raw documents, in five stages, each written as Parquet and read again as the next one's input.

Rejected and dropped are: documents of which the quality rules leave less than half; lines in more than 50 documents, but
for one holder each; all but one document of each group of near duplicates; documents that share a passage with the
benchmark. What is left is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import bpe, decontam, line_dedup, near_dedup, quality
from folioforge.llm.common import table
from folioforge.plans.lineage import shared_dir, to_delete


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` that keep enough of their text; nulls, ties, repeated rows and further columns as in ``quality.clean``."""
    return quality.clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All ``docs`` without frequent lines; nulls, ties, repeated rows and further columns as in ``line_dedup.dedup_lines``."""
    return line_dedup.dedup_lines(docs, keep_first=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one of each group; nulls, ties, repeated rows and further columns as in ``near_dedup.keep_one``."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without a passage of the benchmark; nulls, repeated rows and further columns as in ``decontam``."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, token_ids, n_tokens, sha)`` of each row, as ``bpe.encode`` has it: the ids take the place of all other columns."""
    return bpe.encode_checked(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("byte-level BPE", bpe_encoding),
]

#: MinHash groups and merges by rank are beyond SQL; ``tests/llm/test_pipeline.py`` holds ``run`` against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; the stages' tables are in the shared folder until the process ends."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    to_delete(spark, base)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
