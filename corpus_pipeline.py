"""A corpus pipeline: toxic documents go, one of each near-duplicate class stays, sources are mixed, texts become tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next
one. All but the last return the columns of documents. Nulls, empty and very long texts, repeated rows and empty
tables are as each operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, similar, toxicity
from tidemark.llm.common import fresh_dir, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the labels of sf_dir teach the score."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each class of texts whose five-word shingles are similar to 0.8 or more."""
    return similar.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, always with its whole text."""
    return mixing.apply(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("source_mixing", mixed),
    ("byte_bpe", tokenized),
]

#: A learned score, components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
