"""The corpus pipeline: quality, near-duplicates, personal data, mix, tokens. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from popspark.llm import bpe, minhash, mixing, pii, quality
from popspark.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = docs.select(*COLUMNS)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id."""
    return minhash.deduplicate(docs.select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are generalised or removed; n_chars follows."""
    return pii.sanitise(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.repeat(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and digests."""
    return bpe.encode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", by_quality),
    ("near_duplicates", without_near_duplicates),
    ("pii", without_personal_data),
    ("mix", mixed),
    ("bpe", encoded),
]

#: The classifier's and the tokenizer's stages have no SQL; tests compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
