"""A corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokens. Part of the operators for training data.

Every stage works on all that the one before kept; its result is written as Parquet and read again. In every
stage null texts are empty texts, null ids stay, rows that repeat others are rows like any other unless the stage
takes copies out, further columns travel on, and an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewin.llm import bpe, exact_dedup, minhash, mixing, toxicity
from tidewin.llm.common import stage, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels are read from the tables, by id."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the smallest id stays."""
    return minhash.drop_near_copies(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating: a document comes as often as it is taken, up to three times."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, n_tokens, and the hashes of its ids and of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Toxicity, MinHash and the seeded draws have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last gives a row per document taken into the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
