"""Corpus pipeline: quality rules, language ID, near duplicates, packing.

Defined cases are those of the operators that the stages call; an empty table
passes through all stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and is written as Parquet and read again as the next stage's documents. A stage
drops whole rows and returns the columns of the documents; the last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import langid, minhash, packing, quality
from factloom.llm.common import table
from factloom.session import ensure_checkpoint_dir

#: Text chunks whose ids a worker keeps: its memory comes on top of a JVM that three stages have grown.
MEMO = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade keeps."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from a sample of those that name theirs."""
    return langid.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles."""
    return minhash.unique(docs, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, memo=MEMO)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: A trained model and a packing are not for SQL to express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
