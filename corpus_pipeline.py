"""A training-data pipeline of five stages, each of which works on all that its predecessor kept.

Every stage's result is written as Parquet to the shared folder and read again as the next stage's documents. All but the
last return the columns of documents. Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns
have the results that the operators of lithic.llm state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import decontam, exact_dedup, near_dedup, packing, toxicity
from lithic.llm.common import stage, table, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go: score 0.5 or more by a model of the labelled training fold."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest original, then the smallest doc_id, stays."""
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}")
    try:
        return exact_dedup.dedup(index, docs)
    finally:
        index.drop()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, Jaccard 0.8) one row stays, that of the smallest doc_id."""
    return near_dedup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found, with at most a fifth of its words edited, go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids (little-endian unsigned 32-bit) and their crc32."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express learned scores, MinHash classes or a tokenizer; tests/llm runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        unstage(before)  # a stage's input isn't read again once its result is written
    return docs
