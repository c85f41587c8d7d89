"""Registered queries: a name, a Spark function and its DuckDB check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import lexical
from ..operators import scoring
from ..sources.synthesize import synthesize_corpus
from . import sqlbase as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

Frame = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB equivalent."""
    def add(fn: Frame) -> Frame:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(keys: DataFrame, key: str) -> DataFrame:
    """Keys over all cores: eight bytes of key grow into a whole script to analyse,
    so file splits sized for bytes read would be far too coarse."""
    return keys.select(key).repartition(keys.sparkSession.sparkContext.defaultParallelism, key)


def spread_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents over all cores: a text grows into thousands of grams, so one
    split of bytes read is too much work for one task."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The study corpus: one generated script per order."""
    return synthesize_corpus(spread(table(spark, sf, "orders"), "o_orderkey"), "o_orderkey")


def holdout(spark: SparkSession, sf: str) -> DataFrame:
    """An independent corpus: one script per customer, another seed."""
    return synthesize_corpus(spread(table(spark, sf, "customer"), "c_custkey"), "c_custkey", seed=2024, prefix="h_")


def benign(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus of benign rows only: scripts per part that are labelled safe."""
    return synthesize_corpus(
        spread(table(spark, sf, "part"), "p_partkey"), "p_partkey", seed=77, prefix="x_").filter("label = 0")


def scored(spark: SparkSession, sf: str, source: Frame = corpus) -> DataFrame:
    """id, category, label, template, 13 features, logit, risk, level, dangerous."""
    rows = source(spark, sf).select("id", "category", "label", "template", "script")
    return scoring.score(scoring.features_for(rows)).drop("script")


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.parse_scripts(corpus(spark, sf).select("id", "script"))


def r6(c: Column | str) -> Column:
    """Six places: sums of doubles depend on the order of addition."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def d6(expr: str) -> str:
    return f"round({expr}, 6)"


SCORED = Q.corpus_scored()
HOLDOUT = Q.corpus_scored("customer", "c_custkey", 2024, "h_", "_h")
BENIGN = Q.corpus_scored("part", "p_partkey", 77, "x_", "_x")
PARSED = ",\n".join([Q.scripts(), Q.parsed()])
