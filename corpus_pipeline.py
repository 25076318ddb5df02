"""Corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Toxic documents go, then later copies, then all but one document of each near-duplicate group; secrets are masked in the
texts that stay, which are packed into sequences last. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import exact_dedup, near_dup, packing, secret_scan, toxicity
from mapweave.llm.common import read
from mapweave.session import cut_lineage

NEAR_PERCENT = 80  # of the near-duplicate stage; op5_near_dup has a threshold of its own


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model, trained on the labelled ones, predicts to be toxic."""
    return toxicity.clean_rows(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with the smallest doc_id."""
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of texts that share 80 % of their five-word shingles."""
    return near_dup.first_of_groups(docs, NEAR_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span masked."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its place in a sequence of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near-duplicates", drop_near_copies), ("secret scan", mask_secrets), ("packing", pack),
]
# A trained score, signatures and packing are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written before the next one, which reads it several times."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
