"""The corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from witnesslake.llm import bpe, decontam, linededup, quality, simhash
from witnesslake.llm.common import discard, shared_folder, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on all labelled documents, whatever of them is in docs."""
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), weights)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-equal lines go; a document whose lines have all gone stays, with an empty text."""
    return linededup.remove_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and what its text encodes to: number of tokens, digests of the ids and of the bytes they decode to."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]
#: The classifier is trained, which SQL cannot express; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written to the shared folder as Parquet and read again, and deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        discard(*before)
        docs = spark.read.parquet(f"{folder}/{name}")
        docs.stored_at = f"{folder}/{name}"
        before = [docs]
    return docs
