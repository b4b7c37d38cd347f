"""The corpus pipeline: documents are filtered, deduplicated, redacted, mixed and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helispan.llm import jaccard, mixing, packing, quality, secrets
from helispan.session import finished


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: 5-word shingles, similarity of 0.8 or more."""
    return jaccard.deduplicate(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths, each a sequence, with a checksum of their ids."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: SQL cannot express the tokenizer of the last stage; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and goes when the next one is written."""

    def upto(k: int) -> DataFrame:
        if k < 0:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        name, stage = STAGES[k]
        return finished(spark, lambda: stage(spark, upto(k - 1), sf_dir), name)

    return STAGES[-1][1](spark, upto(len(STAGES) - 2), sf_dir)
