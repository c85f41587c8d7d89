"""The opN queries: each applies its operator, with production parameters, to a whole
table.  ``vocabulary`` paths come from the installed package of public tokenizers."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, chunked_bpe, decontaminate, exact_dedup, ngram_lm, pii, repeats, simhash, spelling, token_count, toxicity, url_filter,
    whitening,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


@query("op1_bpe_encode_decode")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf, "documents"), BYTE_BPE))


@query("op2_simhash")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf, "documents"))


@query("op3_lm_scores")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf, "documents"))


@query("op4_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.text_groups(table(spark, sf, "documents"), keep="max")


@query("op5_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf, "documents"), BYTE_BPE)


@query("op6_decontamination", r"""
    WITH cut_docs AS (
      SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents
      WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    cut_items AS (
      SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
    items AS (SELECT item_id, w, least(5, len(w)) AS k FROM cut_items WHERE len(w) > 0),
    item_shingles AS (
      SELECT DISTINCT item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s
      FROM items),
    sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
    doc_shingles AS (
      SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s
      FROM cut_docs, (SELECT DISTINCT k FROM items)),
    hits AS (
      SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (k, s)
      GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
    FROM hits JOIN sizes USING (item_id) WHERE n_shared >= ceil(n_shingles * 0.8 - 1e-9)""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_repeats")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


# FIXED VALUES: the listed rules.
URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]


@query("op9_url_filter")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages"), URL_RULES)


@query("op10_pii")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_identifiers(table(spark, sf, "documents"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    coded = chunked_bpe.round_trip(table(spark, sf, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_spelling_groups")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))
