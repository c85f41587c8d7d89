"""Agreement of two annotators: inputs are (id, label) frames with unique ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K
from ..functions.tables import with_row


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id", F.col("label").alias("label_a")).join(
        b.select("id", F.col("label").alias("label_b")), "id")


def agreement_confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    return _pairs(a, b).groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def _kappa(po: Column, pe: Column) -> Column:
    return F.when(pe == 1.0, F.when(po == 1.0, 1.0).otherwise(0.0)).otherwise(
        (po - pe) / (F.lit(1.0) - pe))


def cohen_kappa(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, observed and expected agreement, kappa."""
    cells = agreement_confusion(a, b)
    total = cells.agg(F.sum("n").alias("n"),
                      F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("label_a").alias("label"), F.col("n").alias("in_a"), F.lit(0).cast("bigint").alias("in_b")),
        F.struct(F.col("label_b").alias("label"), F.lit(0).cast("bigint").alias("in_a"), F.col("n").alias("in_b")),
    )).alias("s")).select("s.*")
    marginals = sides.groupBy("label").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    chance = marginals.agg(F.sum(F.col("in_a").cast("double") * F.col("in_b")).alias("chance"))
    one = with_row(total, chance)
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, F.col("chance") / (n * n)
    return one.select("n", po.alias("observed"), pe.alias("expected"), _kappa(po, pe).alias("kappa"))


def kappa_band(kappa: Column) -> Column:
    (b0, l0), *rest = K.KAPPA_BANDS
    band = F.when(kappa < b0, l0)
    for bound, name in rest:
        band = band.when(kappa < bound, name)
    return band.otherwise(K.KAPPA_TOP_BAND)


def agreement_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per id that is not plain agreement: disagreement, only_a or only_b."""
    both = a.select("id", F.col("label").alias("label_a")).join(
        b.select("id", F.col("label").alias("label_b")), "id", "full_outer")
    kind = (F.when(F.col("label_b").isNull(), "only_a").when(F.col("label_a").isNull(), "only_b")
            .when(F.col("label_a") != F.col("label_b"), "disagreement"))
    return both.withColumn("kind", kind).filter("kind is not null")


def agreement_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One summary row; the ids behind the counts come from ``agreement_rows``."""
    both = a.select("id", F.col("label").alias("label_a")).join(
        b.select("id", F.col("label").alias("label_b")), "id", "full_outer")
    la, lb = F.col("label_a"), F.col("label_b")
    counts = both.agg(
        F.count_if(la.isNotNull() & lb.isNotNull()).alias("n_scored"),
        F.count_if(la != lb).alias("n_disagreements"),
        F.count_if(lb.isNull()).alias("n_only_a"), F.count_if(la.isNull()).alias("n_only_b"))
    kappa = cohen_kappa(a, b).select("observed", "kappa")
    one = with_row(counts, kappa)
    return one.select(
        "n_scored", F.round("observed", 4).alias("raw_agreement"), F.round("kappa", 4).alias("cohen_kappa"),
        kappa_band(F.col("kappa")).alias("band"), "n_disagreements", "n_only_a", "n_only_b")
