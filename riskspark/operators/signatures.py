"""Weighted signature matching.

The patterns are plan-time literals: one boolean column per signature, so a row
stays one row (a join with a pattern table would multiply the corpus by 40).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed as K
from ..functions.lexical import contains_any

CATEGORIES = [c for c in K.SIGNATURE_CATEGORIES]
HIT_TYPE = "array<struct<id:string,category:string,weight:double,rationale:string>>"


def signature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        K.SIGNATURES, "id string, category string, weight double, regex string, rationale string")


def _flag(sig_id: str) -> str:
    return f"sig_{sig_id}"


def flag_signatures(df: DataFrame, text: str = "script") -> DataFrame:
    """One boolean column ``sig_<id>`` per signature."""
    t = F.col(text)
    return df.withColumns({_flag(s[0]): matches(t, s[0], s[3]) for s in K.SIGNATURES})


def matches(text: Column, sig_id: str, pattern: str) -> Column:
    """Regex search behind plain substring tests that any match must pass."""
    tests = [contains_any(text, group) for group in K.SIGNATURE_NEEDS[sig_id]]
    guard = tests[0]
    for test in tests[1:]:
        guard = guard & test
    return guard & text.rlike("(?dm)" + pattern)


def drop_flags(df: DataFrame) -> DataFrame:
    return df.drop(*[_flag(s[0]) for s in K.SIGNATURES])


def hits_array() -> Column:
    """Matched signatures in knowledge-base order, from the flag columns."""
    found = [
        F.when(F.col(_flag(i)), F.struct(
            F.lit(i).alias("id"), F.lit(cat).alias("category"),
            F.lit(w).alias("weight"), F.lit(why).alias("rationale")))
        for i, cat, w, _, why in K.SIGNATURES
    ]
    return F.filter(F.array(*found), lambda h: h.isNotNull())


def hit_ids() -> Column:
    found = [F.when(F.col(_flag(s[0])), F.lit(s[0])) for s in K.SIGNATURES]
    return F.filter(F.array(*found), lambda h: h.isNotNull())


def category_sum(category: str) -> Column:
    """Summed weight of one category, from the flag columns."""
    total = F.lit(0.0)
    for i, cat, w, _, _ in K.SIGNATURES:
        if cat == category:
            total = total + F.when(F.col(_flag(i)), F.lit(w)).otherwise(F.lit(0.0))
    return total


def match_signatures(df: DataFrame, text: str = "script") -> DataFrame:
    """Add ``hits``: array of (id, category, weight, rationale)."""
    return drop_flags(flag_signatures(df, text).withColumn("hits", hits_array()))


def signature_hits(df: DataFrame, text: str = "script") -> DataFrame:
    """Long form: one row per (id, signature).

    An exploded column, unlike an exploded expression, gets a filter on its size, which
    goes below every projection (into the join that makes the texts) and matches again.
    """
    exploded = flag_signatures(df, text).select("id", F.explode(hits_array()).alias("hit"))
    return exploded.select("id", F.col("hit.id").alias("signature_id"),
                           "hit.category", "hit.weight")


def aggregate_weight(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["weight"])


def category_breakdown(df: DataFrame, text: str = "script") -> DataFrame:
    """Summed weight per (id, category) with at least one hit; no shuffle."""
    flagged = flag_signatures(df, text)
    members = {c: [s[0] for s in K.SIGNATURES if s[1] == c] for c in CATEGORIES}
    entries = []
    for cat, ids in members.items():
        any_hit = F.col(_flag(ids[0]))
        for i in ids[1:]:
            any_hit = any_hit | F.col(_flag(i))
        entries.append(F.when(any_hit, F.struct(
            F.lit(cat).alias("category"), category_sum(cat).alias("weight"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())  # exploded as in signature_hits
    return flagged.select("id", F.explode(found).alias("e")).select("id", "e.category", "e.weight")


def signature_usage(df: DataFrame, text: str = "script") -> DataFrame:
    """Rows hit per signature, silent signatures included."""
    flagged = flag_signatures(df, text)
    counted = flagged.agg(*[F.count_if(F.col(_flag(s[0]))).alias(s[0]) for s in K.SIGNATURES])
    pairs = F.array(*[F.struct(F.lit(s[0]).alias("signature_id"), F.lit(s[1]).alias("category"),
                               F.lit(s[2]).alias("weight"), F.col(s[0]).alias("n_rows"))
                      for s in K.SIGNATURES])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")


def signature_lint(kb: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Problems of a knowledge base: repeated ids, missing keys, unknown categories."""
    known = CATEGORIES if categories is None else categories
    repeated = (kb.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select("id", F.lit("duplicate id").alias("problem")))
    blank = kb.filter(
        F.col("id").isNull() | F.col("category").isNull() | F.col("weight").isNull()
        | F.col("regex").isNull() | F.col("rationale").isNull()
    ).select("id", F.lit("missing key").alias("problem"))
    unknown = kb.filter(~F.col("category").isin(known)).select(
        "id", F.lit("unknown category").alias("problem"))
    return repeated.unionByName(blank).unionByName(unknown)
