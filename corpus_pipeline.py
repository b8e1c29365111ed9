"""The corpus pipeline: five stages over documents, each written and read again.

Each stage works on all rows its predecessor kept and acts on its decisions: rejected
documents and surplus near-duplicates go, repeated passages are cut out of the texts,
secrets are masked, and what is left is packed. All stages but the last return the
columns of documents; ``n_chars`` follows the text.

Defined cases, each that of the stage's operator: documents without text or with fewer than ten words
fail the quality rules; rows without doc_id are kept by near-dedup and substring dedup; of rows alike in doc_id
and text one stays; other columns, whatever their names, pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm import neardup, packing, quality_rules, secrets, substrings
from permspark.llm.common import cut, table


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence rules."""
    return quality_rules.keep(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id."""
    return neardup.keep(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 50-word windows that start in an earlier document, too."""
    return _measured(substrings.strip(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with all secrets masked."""
    return _measured(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' tokens, packed into sequences. Python workers outlive a stage, so none keeps its encoder."""
    return packing.pack_documents(docs, resident=False)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_distinct),
    ("substring_dedup", cut_passages),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Tokens are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
