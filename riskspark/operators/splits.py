"""Repeatable splits and folds.

Rows are ordered by ``md5(seed | id)``, so membership depends on ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as K, ranking
from ..functions.hashing import digest
from ..session import stored


def _shuffle_key(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_md5", digest(seed, F.col(id_col)))


def stratified_split(df: DataFrame, frac: float = 0.4, seed: int = K.SPLIT_SEED,
                     id_col: str = "id", strata: tuple = ("category", "label")) -> DataFrame:
    """Add ``split``: ``max(1, round(n * frac))`` rows of every stratum go to
    ``test``; a stratum of one row stays in ``train``."""
    keys = list(strata)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    rows = ranking.ranked(_shuffle_key(df, id_col, seed), keys,
                          ranking.hash_bucket(F.col("_md5")), [F.col("_md5"), F.col(id_col)], "_rank")
    n_test = F.when(F.col("_size") > 1, F.greatest(
        F.lit(1.0), F.bround(F.col("_size") * F.lit(frac)))).otherwise(F.lit(0.0))
    return (rows.join(sizes, keys)
            .withColumn("split", F.when(F.col("_rank") <= n_test, "test").otherwise("train"))
            .drop("_md5", "_rank", "_size"))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = K.SPLIT_SEED,
                     id_col: str = "id", label: str = "label") -> DataFrame:
    """Add ``fold`` in 0..k-1 with the label ratio kept in every fold."""
    rows = ranking.ranked(_shuffle_key(df, id_col, seed), [label],
                          ranking.hash_bucket(F.col("_md5")), [F.col("_md5"), F.col(id_col)], "_rank")
    return rows.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_md5", "_rank")


def fold_of_groups(df: DataFrame, k: int = 5, seed: int = K.SPLIT_SEED,
                   group: str = "template", label: str = "label") -> DataFrame:
    """(group, fold): whole groups in one fold, large groups dealt first.

    Groups are ranked by size inside their majority label and dealt back and
    forth over the folds.  Only one row per group is ordered, cut by size and hash.
    """
    groups = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_size"), F.sum(label).alias("_pos"))
    groups = groups.withColumns({
        "_major": F.when(F.col("_pos") * 2 > F.col("_size"), 1).otherwise(0),
        "_md5": digest(seed, F.col(group)),
    })
    bucket = F.struct((-F.col("_size")).alias("s"), ranking.hash_bucket(F.col("_md5")).alias("h"))
    rows = ranking.ranked(groups, ["_major"], bucket,
                          [F.col("_size").desc(), F.col("_md5"), F.col(group)], "_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(2 * k))
    fold = F.when(turn < k, turn).otherwise(F.lit(2 * k - 1) - turn)
    return rows.select(group, fold.cast("int").alias("fold"))


def grouped_folds(df: DataFrame, k: int = 5, seed: int = K.SPLIT_SEED,
                  group: str = "template", label: str = "label") -> DataFrame:
    """Add ``fold`` with every group wholly inside one fold.

    The table of folds has one row per group and is written first: Spark plans by its true
    size, so a small one is broadcast, and beyond that skew joins split a hot group.
    """
    return df.join(stored(fold_of_groups(df, k, seed, group, label), "folds"), group)


def cv_summary(per_fold: DataFrame, metrics: list[str], keys: list[str] = []) -> DataFrame:
    """mean, population deviation, min, max and values per metric over the folds."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = per_fold.select(*keys, "fold", F.explode(pairs).alias("p")).select(
        *keys, "fold", "p.metric", "p.value").filter("value is not null")
    # k values per metric: the list is as long as the number of folds.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda x: x["value"])
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), ordered.alias("values"))
