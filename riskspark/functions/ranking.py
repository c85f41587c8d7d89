"""Ranks and running totals over groups of any size.

A plain ``row_number() over (partition by label order by ...)`` sorts a whole
class in one task.  Here the order is cut into many coarse buckets first: bucket
sizes are counted, small running totals turn them into offsets, and the exact
rank is found inside each bucket.  The result equals the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_BUCKET_DIGITS = 3  # 4096 buckets per group
SCORE_BUCKETS_PER_LOGIT = 64
SCORE_LOGIT_LIMIT = 40.0


def hash_bucket(hex_text: Column) -> Column:
    """The leading hex digits: an even cut of anything ordered by a digest."""
    return F.coalesce(F.substring(hex_text, 1, HASH_BUCKET_DIGITS), F.lit(""))


def _never_null(bucket: Column) -> Column:
    """A join key that cannot be null gets no inferred ``is not null`` filter; such
    a filter would copy the whole score expression below the projections."""
    return F.coalesce(bucket.cast("int"), F.lit(0))


def score_bucket(score: Column) -> Column:
    """A coarse, order-keeping bucket of a probability, even over its logit."""
    edge = F.lit(SCORE_LOGIT_LIMIT)
    inner = F.ln(score / (F.lit(1.0) - score))
    clamped = F.when(score <= 0, -edge).when(score >= 1, edge).otherwise(
        F.greatest(-edge, F.least(edge, inner)))
    return _never_null(F.floor(clamped * SCORE_BUCKETS_PER_LOGIT))


def value_bucket(value: Column) -> Column:
    """A coarse, order-keeping bucket of any double, even over its logarithm."""
    size = F.floor(F.ln(F.lit(1.0) + F.abs(value)) * SCORE_BUCKETS_PER_LOGIT)
    return _never_null(F.when(value < 0, -size).otherwise(size))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column],
           name: str = "rank") -> DataFrame:
    """Add the 1-based row number of each row in its group.

    ``bucket`` must be a coarse prefix of ``order``.
    """
    keys = group + ["_bucket"]
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("_inner", F.row_number().over(inside))
    return (
        numbered.join(offsets, keys)
        .withColumn(name, F.col("_inner") + F.col("_offset"))
        .drop("_bucket", "_inner", "_offset")
    )


def running(df: DataFrame, group: list[str], bucket: Column, order: str, sums: list[str],
            descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Add running totals of ``sums`` along ``order`` (one row per group and value).

    With ``descending`` the totals run from the highest value down.  The sum over
    the whole group comes along as ``all_<name>``.
    """
    keys = group + ["_bucket"]
    rows = df.withColumn("_bucket", bucket)

    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    before = Window.partitionBy(*group).orderBy(direction("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(Window.partitionBy(*group)).alias(f"all_{s}") for s in sums])
    inside = Window.partitionBy(*keys).orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({f"_c_{s}": F.sum(s).over(inside) for s in sums}).join(offsets, keys)
    return out.withColumns(
        {prefix + s: F.col(f"_c_{s}") + F.col(f"_o_{s}") for s in sums}
    ).drop("_bucket", *[f"_c_{s}" for s in sums], *[f"_o_{s}" for s in sums])
