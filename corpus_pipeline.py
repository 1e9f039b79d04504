"""The corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage reads what its predecessor kept and writes its result as Parquet to the shared folder
of spark.checkpoint.dir; the next stage reads it back. Stages keep the columns of documents, the
last returns one row of token figures for each document. Empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import bpe, decontam, neardup, quality, secrets
from shelfsight.llm.common import shared_folder, table

#: No stage but the secret scan is expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids, the smaller side of the join."""
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; rows that it cannot score by id stay."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return _without(docs, scored.where("predicted = 0"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return _without(docs, neardup.near_duplicates(docs, words=5, percent=80).where("NOT kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), size=13, percent=5)
    return _without(docs, found.where("contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets masked."""
    return secrets.redact(docs.select(*COLUMNS))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document, encoded and decoded again."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("byte_bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
