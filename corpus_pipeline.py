"""Five corpus stages, each over all rows that its predecessor kept.

Each stage's result is written as Parquet to the folder that the executors share and reread by the next one, so a lost
executor repeats tasks of one stage at most. The stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, classifier, exact, mixing, simhash
from graphloom.llm.common import shared_dir, table
from graphloom.session import remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it learns from the labelled rows of ``docs``."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, also where all its ids are null."""
    return exact.keep_one(docs, null_ids=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by probabilities that are calibrated to the target weights."""
    return mixing.keep_sampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each remaining text, encoded and decoded again."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing", mixed),
    ("bpe encoding", encoded),
]

#: SQL cannot express the classifier, the fingerprints or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:  # nothing reads the stage before any more
            remove(spark, f"{at}/{k - 1}")
    return docs
