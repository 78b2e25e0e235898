"""A corpus from raw documents to packed training rows, as five stages.

Nulls and edge cases, for all stages: a null text counts as an empty one (the classifier scores it like any other, the
quality rules reject it); rows with a null id are judged like others, but each is a document of its own for near-dedup; of
rows with the same id near-dedup keeps one, if its group keeps that id; texts are taken whole; extra columns go through
all stages but the last, whatever their names; a table without `source` or `n_chars` columns, or without rows, is taken too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.checkpoint import shared_table
from lumenfold.llm import neardup, packing, quality, repetition, secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules go."""
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Links are at a similarity of 0.80 or more (op10_neardup: 0.85). With 36 of 64 matches the search finds a pair at
    exactly 0.80 with a probability of 1 - 4.2e-6 and closer ones still more surely; what it finds is confirmed exactly.
    """
    return neardup.drop_near_duplicates(docs, percent=80, matches=36)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the trained models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage keeps is written once to the shared folder, as the next one reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
