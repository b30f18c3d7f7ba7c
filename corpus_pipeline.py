"""The corpus pipeline: STAGES in order, and ``run``, which applies them to the documents of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnlake.llm import dedup, mixing, packing, quality, secrets
from txnlake.llm.common import read
from txnlake.plans.groups import durable

#: Near-duplicates share this many percent of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and are no outliers of their language and source."""
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return dedup.one_of_each(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 2048."""
    return packing.pack_table(docs)


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: SQL has neither the tokenizer of the last stage nor the iterated estimates of the first.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
