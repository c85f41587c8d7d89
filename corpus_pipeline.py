"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again before the next one starts, so a lost executor costs one stage at most.
The first four drop documents and leave all columns as they are; the last returns token
ids.  Null texts count as empty, a document with a null id is never dropped, and an empty
table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm import bpe, decontaminate, exact_dedup, similar, toxicity
from riskspark.llm.common import Scratch, table
from riskspark.llm.queries import BYTE_BPE


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold of their language."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the largest id."""
    return exact_dedup.drop_copies(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word Jaccard 0.8 or more."""
    return similar.drop_similar(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document."""
    coded = bpe.round_trip(docs, BYTE_BPE)
    return coded.select("doc_id", *bpe.digest_columns(), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("bpe", token_ids),
]

# A trained network and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return docs
