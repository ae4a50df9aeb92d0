"""From raw documents to packed training sequences: quality rules, near-duplicates, secrets, source mix, packing.

Every stage takes (spark, docs, sf_dir), reads ``docs`` alone and is written as Parquet before the next one reads it. All
stages but the last return the columns of documents. The result has one row for each piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowguard.session import materialize
from llm import mixing, near_copies, packing, quality_rules, secret_scan, simhash
from llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the release policy rejects go."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (SimHash, exact check and join: five words, similarity 0.8) stays: the one with the smallest id."""
    return simhash.one_of_each(docs, near_copies.classes(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans that the scan finds are masked in their texts."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeated epochs are repeated rows."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its sequence and its place there."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("source_mix", mix),
    ("packing", pack),
]

# XXH64 fingerprints and tokenizers have no counterpart in SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
