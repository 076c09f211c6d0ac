"""A training corpus in five stages, each fed with what its predecessor wrote.

Quality rules drop documents, near-dedup keeps one of each group, the secret scan masks what
it finds, mixing repeats and cuts documents to the sources' targets and puts them in the order of
its schedule, packing ends in pieces.

In every stage: a null text counts as empty, very long texts are read whole, an empty table gives
none, and columns beside doc_id, text, source and n_chars may have any names and types and are kept
(packing returns its own). Each stage says below what it does with ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxforge.llm import mixing, near_dedup, packing, quality_rules, secrets
from ctxforge.llm.shared import discard, materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged one by one, so repeated rows stay or go together; null and empty texts go."""
    return quality_rules.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the smallest id stays, of rows that repeat it one; texts without words are groups of their own."""
    return near_dedup.kept_documents(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, repeated ones are masked alike; a null text stays null."""
    return secrets.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat an id are mixed as rows of their own; texts without words are left out; a null source is a source."""
    return mixing.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat an id are packed each; a null or empty text is its closing id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near dedup", drop_near_copies),
    ("secret scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]
#: Near-dedup, the secret scan, mixing and packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)  # what this stage was made of
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
