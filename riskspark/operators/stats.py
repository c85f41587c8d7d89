"""Intervals, paired tests and calibration.

Bootstraps work on counts.  Drawing n rows with replacement from a class and
counting the correct ones is one binomial draw, so each replicate takes its
counts from the binomial distribution itself (inverse of its cumulative sum at a
repeatable uniform number).  That is the resampling distribution exactly, and
its cost grows with the square root of the corpus, not with rows x replicates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed as K, ranking
from ..functions.hashing import digest, hex_number, uniform
from ..functions.tables import with_row
from ..session import checkpointed, stored
from . import metrics as M

BOOT_METRICS = ["precision", "recall", "f1", "mcc", "accuracy", "false_positive_rate"]
CLUSTER_METRICS = ["precision", "recall", "f1", "false_positive_rate"]
# Bernstein's inequality bounds the chance beyond t = L/3 + sqrt(L^2/9 + 2 L var) by
# exp(-L) on either side.  exp(-40) is far below the 2^-53 steps of the uniform numbers,
# so no draw is cut off, whatever the mean.
TAIL = 40.0
EXACT_FACTORIAL = 20


def ln_factorial(x: Column) -> Column:
    """ln(x!): exact up to 20, Stirling's series (error < 1e-14) beyond."""
    d = F.greatest(x, F.lit(1)).cast("double")
    series = (d * F.ln(d) - d + F.lit(0.5) * F.ln(F.lit(2.0 * math.pi) * d)
              + F.lit(1.0) / (F.lit(12.0) * d) - F.lit(1.0) / (F.lit(360.0) * d * d * d)
              + F.lit(1.0) / (F.lit(1260.0) * d * d * d * d * d))
    small = F.ln(F.factorial(F.least(x, F.lit(EXACT_FACTORIAL)).cast("int")).cast("double"))
    return F.when(x <= EXACT_FACTORIAL, small).otherwise(series)


def binomial_pmf(n: Column, k: Column, p: Column) -> Column:
    def times_ln(count: Column, prob: Column) -> Column:
        return F.when(count == 0, F.lit(0.0)).otherwise(count * F.ln(prob))

    inner = (ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
             + times_ln(k, p) + times_ln(n - k, F.lit(1.0) - p))
    return (F.when(p <= 0, F.when(k == 0, 1.0).otherwise(0.0))
            .when(p >= 1, F.when(k == n, 1.0).otherwise(0.0)).otherwise(F.exp(inner)))


def _cumulative(params: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, k and the cumulative probability ``v`` over the range that matters."""
    n, p = F.col("n"), F.col("p")
    mean, var = n * p, n * p * (F.lit(1.0) - p)
    reach = F.lit(TAIL / 3) + F.sqrt(F.lit(TAIL**2 / 9) + F.lit(2 * TAIL) * var)
    lo = F.greatest(F.lit(0.0), F.floor(mean - reach) - 2).cast("bigint")
    hi = F.least(n, (F.ceil(mean + reach) + 2).cast("bigint"))
    table = params.withColumn("k", F.explode(F.sequence(lo, hi))).withColumn(
        "_pmf", binomial_pmf(n, F.col("k"), p)).withColumn("lo", lo).withColumn("hi", hi)
    order_k = Window.partitionBy(*keys).orderBy("k").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return table.withColumn("v", F.sum("_pmf").over(order_k)).drop("_pmf")


def binomial_draws(params: DataFrame, uniforms: DataFrame, keys: list[str]) -> DataFrame:
    """Many draws from each of a few binomials.

    ``params``: keys, n, p.  ``uniforms``: keys, b, u.  Returns keys, b, draw: the
    lowest k whose cumulative probability reaches u.  Cumulative values and
    uniforms are merged in one ordered pass per key, so no pair of a draw and a
    table row is ever formed.
    """
    cdf = _cumulative(params, keys).select(
        *keys, "v", "lo", F.lit(0).alias("is_draw"), F.lit(None).cast("int").alias("b"))
    points = uniforms.select(*keys, F.col("u").alias("v"), F.lit(None).cast("bigint").alias("lo"),
                             F.lit(1).alias("is_draw"), F.col("b").cast("int").alias("b"))
    upto = Window.partitionBy(*keys).orderBy("v", F.col("is_draw").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    merged = cdf.unionByName(points).withColumns({
        "_below": F.sum(F.lit(1) - F.col("is_draw")).over(upto),
        "_size": F.sum(F.lit(1) - F.col("is_draw")).over(whole),
        "_first": F.max("lo").over(whole),
    })
    return merged.filter("is_draw = 1").select(
        *keys, "b", (F.col("_first") + F.least(F.col("_below"), F.col("_size") - 1)).alias("draw"))


def binomial_quantile(n: Column, p: Column, u: Column) -> Column:
    """The lowest k whose cumulative binomial probability reaches u, row by row.

    Neighbouring terms differ by a ratio, so a walk up from the lowest k that matters
    needs no table.  Rows of an Arrow batch walk side by side until each has arrived.
    """
    tail = TAIL

    @F.pandas_udf("long")
    def drawn(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
        n, p, u = n.to_numpy(), p.to_numpy(), u.to_numpy()
        out = np.where(p >= 1, n, 0)
        rows = np.flatnonzero((n > 0) & (p > 0) & (p < 1))
        n, p, u = n[rows].astype(float), p[rows], u[rows]
        reach = tail / 3 + np.sqrt(tail**2 / 9 + 2 * tail * n * p * (1 - p))
        at = np.maximum(0, np.floor(n * p - reach) - 2)
        ln_factorial = np.frompyfunc(lambda x: math.lgamma(x + 1), 1, 1)
        ways = (ln_factorial(n) - ln_factorial(at) - ln_factorial(n - at)).astype(float)
        term = np.exp(ways + at * np.log(p) + (n - at) * np.log1p(-p))
        odds, total = p / (1 - p), np.zeros(len(rows))
        while len(rows):
            total = total + term
            on = (total < u) & (at < n)
            out[rows[~on]] = at[~on]
            rows, n, u, odds, at, total, term = (x[on] for x in (rows, n, u, odds, at, total, term))
            term = term * (n - at) / (at + 1) * odds
            at = at + 1
        return pd.Series(out)

    return drawn(n, p, u)


def _long(cells: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return cells.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", "p.value")


def _interval(long: DataFrame, alpha: float) -> DataFrame:
    # n_boot values per metric; percentile() interpolates linearly.
    return long.groupBy("metric").agg(
        F.percentile("value", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("value", F.lit(1 - alpha / 2)).alias("ci_high"),
        F.count(F.lit(1)).alias("n_boot"))


def class_bootstrap(cells: DataFrame, n_boot: int = 2000, seed: int = K.SPLIT_SEED) -> DataFrame:
    """Replicates of a class-stratified bootstrap of one row of counts: b, tp, fn, fp, tn."""
    spark = cells.sparkSession
    params = cells.select(F.explode(F.array(
        F.struct(F.lit("pos").alias("cls"), (F.col("tp") + F.col("fn")).alias("n"), F.col("tp").alias("hit")),
        F.struct(F.lit("neg").alias("cls"), (F.col("fp") + F.col("tn")).alias("n"), F.col("fp").alias("hit")),
    )).alias("s")).select("s.cls", "s.n", M.ratio(F.col("s.hit").cast("double"), F.col("s.n")).alias("p"))
    uniforms = spark.range(n_boot).select(
        F.col("id").alias("b"), F.explode(F.array(F.lit("pos"), F.lit("neg"))).alias("cls")).select(
        "cls", "b", uniform(digest(seed, F.col("b"), F.col("cls"))).alias("u"))
    drawn = binomial_draws(params, uniforms, ["cls"])
    sizes = cells.select((F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"))
    wide = drawn.groupBy("b").agg(
        F.max(F.when(F.col("cls") == "pos", F.col("draw"))).alias("tp"),
        F.max(F.when(F.col("cls") == "neg", F.col("draw"))).alias("fp"))
    return with_row(wide, sizes).select(
        "b", "tp", (F.col("n_pos") - F.col("tp")).alias("fn"), "fp",
        (F.col("n_neg") - F.col("fp")).alias("tn"))


def _point(cells: DataFrame, names: list[str]) -> DataFrame:
    return _long(M.metrics_from_counts(cells), names, []).withColumnRenamed("value", "point")


def bootstrap_ci(pred: DataFrame, n_boot: int = 2000, alpha: float = 0.05,
                 seed: int = K.SPLIT_SEED, label: str = "label",
                 predicted: str = "predicted") -> DataFrame:
    """Percentile interval per count-based metric, class-stratified."""
    cells = checkpointed(M.confusion(pred, [], label, predicted))
    replicates = M.metrics_from_counts(class_bootstrap(cells, n_boot, seed))
    return _point(cells, BOOT_METRICS).join(
        _interval(_long(replicates, BOOT_METRICS, []), alpha), "metric")


def _score_splits(counts: DataFrame, depth: int) -> DataFrame:
    """Every inner node of the binary tree over ranked scores: height, node, and the
    share of its positives and of its negatives that lie in its lower half."""
    bit = F.expr("shiftright(rank, height - 1)")
    nodes = counts.withColumn("height", F.explode(F.sequence(F.lit(1), F.lit(depth)))).groupBy(
        "height", F.expr("shiftright(rank, height)").alias("node")).agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg")],
        *[F.sum(F.when(bit % 2 == 0, F.col(c)).otherwise(0)).alias(f"low_{c}") for c in ("pos", "neg")])
    return nodes.select("height", "node", *[
        F.coalesce(M.ratio(F.col(f"low_{c}").cast("double"), F.col(c)), F.lit(0.0)).alias(f"p_{c}") for c in ("pos", "neg")])


def area_replicates(scored: DataFrame, n_boot: int = 2000, seed: int = K.SPLIT_SEED, score: str = "risk",
                    label: str = "label") -> DataFrame:
    """b, roc_auc, pr_auc: areas of class-stratified resamples.

    Rows fold to counts per distinct score, and drawing a class anew is one multinomial
    draw over its scores.  The draw goes down a binary tree over the ranked scores: a
    node's draws split between its halves by one binomial.  Each row (replicate, node)
    carries the draws of its scores and of all scores above them, so the areas are plain
    sums over the leaves.  No row needs another row of its replicate.
    """
    spark = scored.sparkSession
    folded = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    counts = stored(ranking.ranked(folded, [], ranking.score_bucket(F.col("score")), [F.col("score")]).select(
        (F.col("rank") - 1).cast("bigint").alias("rank"), "pos", "neg"), "score-counts")
    n_scores, n_pos, n_neg = counts.agg(F.count("*"), F.sum("pos"), F.sum("neg")).first()
    depth = max(0, (n_scores or 0) - 1).bit_length()
    splits = stored(_score_splits(counts, depth), "score-splits") if depth else None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(0, n_boot if n_scores else 0, 1, max(parts, spark.sparkContext.defaultParallelism)).select(
        F.col("id").alias("b"), *[F.lit(v or 0).cast("bigint").alias(c) for c, v in (
            ("node", 0), ("pos", n_pos), ("neg", n_neg), ("above_pos", 0), ("above_neg", 0))])
    for height in range(depth, 0, -1):
        low = {}
        rows = rows.join(splits.filter(F.col("height") == height).drop("height"), "node")
        for c in ("pos", "neg"):
            u = uniform(digest(seed, F.lit("area"), F.lit(c), F.lit(height), F.col("node"), F.col("b")))
            rows = rows.withColumn(f"low_{c}", binomial_quantile(F.col(c), F.col(f"p_{c}"), u))
            low[c] = F.col(f"low_{c}")
        high = {c: F.col(c) - low[c] for c in low}
        halves = F.array(
            F.struct((F.col("node") * 2 + 1).alias("node"), high["pos"].alias("pos"), high["neg"].alias("neg"),
                     F.col("above_pos"), F.col("above_neg")),
            F.struct((F.col("node") * 2).alias("node"), low["pos"].alias("pos"), low["neg"].alias("neg"),
                     (F.col("above_pos") + high["pos"]).alias("above_pos"), (F.col("above_neg") + high["neg"]).alias("above_neg")))
        rows = rows.select("b", F.explode(halves).alias("half")).select("b", "half.*").filter("pos + neg > 0")
    c = F.col
    upto, before = c("above_pos") + c("pos"), c("above_pos") + c("above_neg")
    here = upto / (before + c("pos") + c("neg"))
    previous = F.when(before > 0, c("above_pos") / before).otherwise(F.lit(1.0))
    sums = rows.groupBy("b").agg(
        F.sum(c("neg") * (c("above_pos").cast("double") + c("pos") / F.lit(2.0))).alias("roc"),
        F.sum(c("pos") * (here + previous) / F.lit(2.0)).alias("pr"))
    both = bool(n_pos and n_neg)
    return sums.select("b", *[(c(part) / F.lit(float(size)) if both else F.lit(None).cast("double")).alias(name) for part, size, name in (
        ("roc", (n_pos or 0) * (n_neg or 0), "roc_auc"), ("pr", n_pos or 0, "pr_auc"))])


def bootstrap_auc_ci(scored: DataFrame, n_boot: int = 2000, alpha: float = 0.05,
                     seed: int = K.SPLIT_SEED, score: str = "risk", label: str = "label") -> DataFrame:
    """Percentile interval of roc_auc and pr_auc, class-stratified; null with one class."""
    areas = area_replicates(scored, n_boot, seed, score, label)
    names = ["roc_auc", "pr_auc"]
    return _long(M.ranking_metrics(scored, [], score, label), names, []).withColumnRenamed("value", "point").join(
        _interval(_long(areas, names, []), alpha), "metric")


# -- clusters -----------------------------------------------------------------
def cluster_cells(pred: DataFrame, cluster: str = "template", label: str = "label",
                  predicted: str = "predicted") -> DataFrame:
    """One confusion row per cluster, written once: all the cluster statistics read it."""
    return checkpointed(M.confusion(pred, [cluster], label, predicted))


def _all_cells(cells: DataFrame) -> DataFrame:
    return cells.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])


def cluster_bootstrap(cells: DataFrame, n_boot: int = 2000, seed: int = K.SPLIT_SEED,
                      cluster: str = "template") -> DataFrame:
    """Replicates that redraw whole clusters: b, tp, fp, tn, fn.  Replicates with
    one class are left out."""
    numbered = ranking.ranked(
        cells.withColumn("_md5", digest(seed, F.col(cluster))), [],
        ranking.hash_bucket(F.col("_md5")), [F.col("_md5"), F.col(cluster)], "pos").drop("_md5")
    size = cells.agg(F.count(F.lit(1)).alias("size"))
    slots = with_row(numbered.select((F.col("pos") - 1).alias("j")), size)
    draws = slots.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).select(
        "b", (F.pmod(hex_number(digest(seed, F.lit("cluster"), F.col("b"), F.col("j")), 1, 12),
                     F.col("size")) + 1).alias("pos"))
    hits = draws.groupBy("b", "pos").agg(F.count(F.lit(1)).alias("times"))
    summed = hits.join(numbered, "pos").groupBy("b").agg(
        *[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "tn", "fn")])
    return summed.filter("tp + fn > 0 and fp + tn > 0")


def _cluster_ci(cells: DataFrame, n_boot: int, alpha: float, seed: int, cluster: str) -> DataFrame:
    replicates = M.metrics_from_counts(cluster_bootstrap(cells, n_boot, seed, cluster))
    return _point(_all_cells(cells), CLUSTER_METRICS).join(
        _interval(_long(replicates, CLUSTER_METRICS, []), alpha), "metric")


def cluster_bootstrap_ci(pred: DataFrame, n_boot: int = 2000, alpha: float = 0.05,
                         seed: int = K.SPLIT_SEED, cluster: str = "template",
                         label: str = "label", predicted: str = "predicted") -> DataFrame:
    return _cluster_ci(cluster_cells(pred, cluster, label, predicted), n_boot, alpha, seed, cluster)


def naive_bootstrap(cells: DataFrame, n_boot: int = 2000, seed: int = K.SPLIT_SEED) -> DataFrame:
    """Replicates that redraw single rows, from one row of counts: b, tp, fp, tn, fn.

    n draws over four cells are three nested binomial draws: positives first,
    then the hits among the positives and among the negatives of the replicate.
    """
    spark = cells.sparkSession
    totals = cells.select(
        "*", (F.col("tp") + F.col("fn")).alias("n_pos"),
        (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n_all"))

    def u(step: Column) -> Column:
        return uniform(digest(seed, step, F.col("b")))

    one = F.lit(0).alias("g")
    first = totals.select(one, F.col("n_all").alias("n"),
                          M.ratio(F.col("n_pos").cast("double"), F.col("n_all")).alias("p"))
    points = spark.range(n_boot).select(one, F.col("id").alias("b")).withColumn("u", u(F.lit("positives")))
    positives = binomial_draws(first, points, ["g"]).select("b", F.col("draw").alias("pos"))
    rates = totals.select("n_all", M.ratio(F.col("tp").cast("double"), F.col("n_pos")).alias("p_tp"),
                          M.ratio(F.col("fp").cast("double"), F.col("n_all") - F.col("n_pos")).alias("p_fp"))
    per_b = with_row(positives, rates)
    params = per_b.select("b", F.explode(F.array(
        F.struct(F.lit("tp").alias("cell"), F.col("pos").alias("n"), F.col("p_tp").alias("p")),
        F.struct(F.lit("fp").alias("cell"), (F.col("n_all") - F.col("pos")).alias("n"), F.col("p_fp").alias("p")),
    )).alias("s")).select("b", "s.*").withColumn("u", u(F.col("cell")))
    drawn = params.withColumn("draw", binomial_quantile(F.col("n"), F.col("p"), F.col("u"))).groupBy("b").agg(
        F.max(F.when(F.col("cell") == "tp", F.col("draw"))).alias("tp"),
        F.max(F.when(F.col("cell") == "fp", F.col("draw"))).alias("fp"))
    return drawn.join(per_b, "b").select(
        "b", "tp", (F.col("pos") - F.col("tp")).alias("fn"), "fp",
        (F.col("n_all") - F.col("pos") - F.col("fp")).alias("tn"),
    ).filter("tp + fn > 0 and fp + tn > 0")


def naive_vs_cluster(pred: DataFrame, n_boot: int = 2000, alpha: float = 0.05,
                     seed: int = K.SPLIT_SEED, cluster: str = "template",
                     label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Interval width when clusters are redrawn against width when rows are."""
    cells = cluster_cells(pred, cluster, label, predicted)
    wide = _cluster_ci(cells, n_boot, alpha, seed, cluster).select(
        "metric", "point", F.col("ci_low").alias("cluster_low"), F.col("ci_high").alias("cluster_high"))
    rows = _interval(_long(M.metrics_from_counts(
        naive_bootstrap(_all_cells(cells), n_boot, seed)), CLUSTER_METRICS, []), alpha).select(
        "metric", F.col("ci_low").alias("naive_low"), F.col("ci_high").alias("naive_high"))
    width = F.col("naive_high") - F.col("naive_low")
    return wide.join(rows, "metric").withColumn("width_ratio", F.when(
        width > 0, F.round((F.col("cluster_high") - F.col("cluster_low")) / width, 2)))


def wilson_interval(df: DataFrame, k: str, n: str, z: float = 1.96) -> DataFrame:
    """Add wilson_point, wilson_low, wilson_high; (0, 0, 1) where n is 0."""
    kk, nn, zz = F.col(k).cast("double"), F.col(n).cast("double"), F.lit(float(z))
    safe = F.greatest(nn, F.lit(1.0))
    p = kk / safe
    den = F.lit(1.0) + zz * zz / safe
    center = (p + zz * zz / (F.lit(2.0) * safe)) / den
    half = zz * F.sqrt(p * (F.lit(1.0) - p) / safe + zz * zz / (F.lit(4.0) * safe * safe)) / den
    empty = nn == 0
    return df.withColumns({
        "wilson_point": F.when(empty, 0.0).otherwise(p),
        "wilson_low": F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), center - half)),
        "wilson_high": F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), center + half)),
    })


# -- paired tests ---------------------------------------------------------------
def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p-value of k successes in n fair trials (k <= n / 2).

    The tail sum runs downwards from its largest term, so only ratios of
    neighbouring terms are needed.  6 * sqrt(n) + 60 terms down they have fallen
    below 1e-30 of the first, far under a double's last digit.
    """
    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (i + 1) / (n - i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    floor = F.greatest(F.lit(0).cast("bigint"), k - F.ceil(F.sqrt(n) * 6 + 60))
    down = F.when(k > 0, F.sequence(k - 1, floor, F.lit(-1).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    relative = F.aggregate(down, start, step, lambda acc: acc["total"])
    top = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) - n * F.ln(F.lit(2.0))
    return F.when(n == 0, 1.0).otherwise(
        F.least(F.lit(1.0), F.lit(2.0) * F.exp(top + F.ln(relative))))


def paired_counts(pred: DataFrame, a: str, b: str, keys: list[str] = [], label: str = "label") -> DataFrame:
    ca = F.col(a).cast("int") == F.col(label)
    cb = F.col(b).cast("int") == F.col(label)
    return pred.groupBy(*keys).agg(
        F.count_if(ca & ~cb).alias("a_correct_b_wrong"), F.count_if(cb & ~ca).alias("b_correct_a_wrong"),
        F.count_if(ca & cb).alias("both_correct"), F.count_if(~ca & ~cb).alias("both_wrong"))


def mcnemar_from_counts(counts: DataFrame) -> DataFrame:
    b, c = F.col("a_correct_b_wrong"), F.col("b_correct_a_wrong")
    out = counts.withColumn("n_discordant", b + c).withColumn(
        "p_value", binomial_two_sided(F.least(b, c), F.col("n_discordant")))
    return out.withColumns({
        "significant": F.col("p_value") < 0.05,
        "better": F.when(b > c, "A").when(c > b, "B").otherwise("tie"),
    })


def mcnemar(pred_a: DataFrame, pred_b: DataFrame, label: str = "label",
            predicted: str = "predicted") -> DataFrame:
    """Exact paired test of two detectors on the ids they share."""
    a = pred_a.select("id", label, F.col(predicted).alias("_a"))
    b = pred_b.select("id", F.col(predicted).alias("_b"))
    return mcnemar_from_counts(paired_counts(a.join(b, "id"), "_a", "_b", [], label))


def ablation_significance(rows: DataFrame, decisions: dict[str, Column], label: str = "label",
                          base: str = "full") -> DataFrame:
    """Each configuration against ``base``; ``decisions`` holds one boolean column per
    configuration over ``rows``.

    All decisions of a row stand side by side, so one pass counts the rows of every
    pattern of label and decisions; the tests work on those few counts.
    """
    flags = F.array(*[F.struct(F.lit(name).alias("config"), c.alias("b")) for name, c in decisions.items()])
    wide = rows.select(F.col(label).alias("label"), decisions[base].alias("_a"), flags.alias("_f"))
    counts = checkpointed(wide.groupBy("label", "_a", "_f").agg(F.count(F.lit(1)).alias("_k")))
    long = counts.select("label", "_a", "_k", F.explode("_f").alias("_c")).select("label", "_a", "_k", "_c.*")
    right_a, right_b = ((F.col(c).cast("int") == F.col("label")) for c in ("_a", "b"))
    paired = long.filter(F.col("config") != base).groupBy("config").agg(
        *[F.coalesce(F.sum(F.when(c, F.col("_k"))), F.lit(0)).alias(name) for name, c in (
            ("both_correct", right_a & right_b), ("a_correct_b_wrong", right_a & ~right_b),
            ("b_correct_a_wrong", ~right_a & right_b), ("both_wrong", ~right_a & ~right_b))])
    f1 = M.classification_metrics(long, ["config"], "label", "b", "_k").select("config", "f1")
    full_f1 = f1.filter(F.col("config") == base).select(F.col("f1").alias("_full"))
    return (with_row(mcnemar_from_counts(paired).join(f1, "config"), full_f1)
            .withColumn("delta_f1", F.round(F.col("f1") - F.col("_full"), 4)).drop("_full"))


# -- calibration ----------------------------------------------------------------
def reliability_bins(scored: DataFrame, n_bins: int = 10, prob: str = "risk",
                     label: str = "label", keys: list[str] = []) -> DataFrame:
    """Count, mean score and positive share per bin; empty bins kept.

    Bins are open on the left and closed on the right, the first closed on both.
    """
    spark = scored.sparkSession
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    p = F.col(prob)
    bin_no = F.lit(-1)  # never null: see ranking._never_null
    for i in reversed(range(n_bins)):
        inside = (p <= edges[i + 1]) & ((p >= edges[i]) if i == 0 else (p > edges[i]))
        bin_no = F.when(inside, i).otherwise(bin_no)
    folded = scored.groupBy(*keys, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"),
        F.avg(F.col(label).cast("double")).alias("accuracy"))
    bins = spark.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(n_bins)], "bin int, lo double, hi double")
    if keys:
        bins = folded.select(*keys).distinct().withColumn("bin", F.explode(
            F.array(*[F.lit(i) for i in range(n_bins)]))).join(F.broadcast(bins), "bin")
    return bins.join(folded, keys + ["bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(scored: DataFrame, n_bins: int = 10, prob: str = "risk",
                               label: str = "label", keys: list[str] = []) -> DataFrame:
    bins = reliability_bins(scored, n_bins, prob, label, keys)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))
    return bins.groupBy(*keys).agg((gap / F.sum("n")).alias("ece"))


def brier_score(scored: DataFrame, prob: str = "risk", label: str = "label",
                keys: list[str] = []) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.avg(F.pow(F.col(prob) - F.col(label), F.lit(2.0))).alias("brier"))


def _score_label_counts(train: DataFrame, prob: str, label: str) -> DataFrame:
    """One weighted row per (score, label): what the calibration fits read."""
    return checkpointed(train.groupBy(F.col(prob).alias("x"), F.col(label).cast("double").alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("w")))


# Points of a block of the isotonic fit.
ISOTONIC_BLOCK = 4096
_POOLS = "block long, at long, low double, high double, w double, wy double"


def isotonic_pools(train: DataFrame, prob: str = "risk", label: str = "label", block: int = ISOTONIC_BLOCK) -> DataFrame:
    """low, high, value: the level sets of the rising step function nearest to the labels.

    Rows fold to distinct scores first.  Blocks of ``block`` scores pool their adjacent
    violators on their own; then neighbours merge pairwise, doubling what a block spans.
    A merge only reads the pools its border can reach: those of the left block at or above
    the first mean of the right one, and those of the right block at or below the last
    mean of the left one.
    """
    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        """Adjacent pools (ordered by ``at``) whose means do not rise become one."""
        pools: list[list] = []
        for row in pdf.sort_values("at")[["block", "at", "low", "high", "w", "wy"]].itertuples(index=False):
            pools.append(list(row))
            # means as products: no rounding of a quotient decides
            while len(pools) > 1 and pools[-2][5] * pools[-1][4] >= pools[-1][5] * pools[-2][4]:
                last = pools.pop()
                pools[-1][3], pools[-1][4], pools[-1][5] = last[3], pools[-1][4] + last[4], pools[-1][5] + last[5]
        return pd.DataFrame(pools, columns=["block", "at", "low", "high", "w", "wy"])

    folded = train.groupBy(F.col(prob).alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("wy"))
    numbered = ranking.ranked(folded, [], ranking.score_bucket(F.col("x")), [F.col("x")], "at")
    points = numbered.select(F.floor((F.col("at") - 1) / block).cast("bigint").alias("block"), F.col("at").cast("bigint").alias("at"),
                             F.col("x").alias("low"), F.col("x").alias("high"), "w", "wy")
    pools = stored(points.groupBy("block").applyInPandas(pooled, _POOLS), "pools")
    mean = F.col("wy") / F.col("w")
    for _ in range(((pools.agg(F.max("block")).first()[0]) or 0).bit_length()):
        pair, right = F.floor(F.col("block") / 2).cast("bigint"), F.col("block") % 2 == 1
        rows = pools.withColumns({"right": right, "pair": pair, "mean": mean})
        ends = rows.groupBy("pair").agg(F.max(F.when(~F.col("right"), F.col("mean"))).alias("left_last"),
                                        F.min(F.when(F.col("right"), F.col("mean"))).alias("right_first"))
        reached = F.when(F.col("right"), F.col("mean") <= F.col("left_last")).otherwise(F.col("mean") >= F.col("right_first"))
        marked = rows.join(ends, "pair").select(F.col("pair").alias("block"), "at", "low", "high", "w", "wy",
                                                F.coalesce(reached, F.lit(False)).alias("reached"))
        merged = marked.filter("reached").drop("reached").groupBy("block").applyInPandas(pooled, _POOLS)
        pools = stored(marked.filter("not reached").drop("reached").unionByName(merged), "pools")
    return pools.select("low", "high", mean.alias("value"))


def isotonic_calibrate(train: DataFrame, test: DataFrame, prob: str = "risk", label: str = "label",
                       out: str = "isotonic", block: int = ISOTONIC_BLOCK) -> DataFrame:
    """Monotone recalibration fitted on ``train``: linear between the fitted scores, flat
    outside their range, null without training rows."""
    pools = isotonic_pools(train, prob, label, block)
    # a pool ends a knot at either side; distinct scores of the test rows look for both neighbours
    knots = pools.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("x"), "value")
    asked = test.select(F.col(prob).alias("x")).distinct().select("x", F.lit(None).cast("double").alias("value"))
    knot = F.when(F.col("value").isNotNull(), F.struct("x", "value"))
    points = knots.unionByName(asked).select("*", knot.alias("knot"), ranking.score_bucket(F.col("x")).alias("bucket"))
    ordered = Window.orderBy("bucket")
    outer = points.groupBy("bucket").agg(F.min("knot").alias("first"), F.max("knot").alias("last")).select(
        "bucket", F.last("last", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    inside = Window.partitionBy("bucket").orderBy("x", F.col("value").isNull())
    near = points.withColumns({
        "_low": F.last("knot", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_high": F.first("knot", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
    }).filter("value is null").join(outer, "bucket").select(
        "x", F.coalesce("_low", "before").alias("l"), F.coalesce("_high", "after").alias("h"))
    x, low, high = F.col("x"), F.col("l"), F.col("h")
    share = (x - low["x"]) / (high["x"] - low["x"])
    value = (F.when(low.isNull(), high["value"]).when(high.isNull() | (low["x"] == x), low["value"])
             .otherwise(low["value"] + (high["value"] - low["value"]) * share))
    fitted = near.select(x.alias("_x"), value.alias(out))
    return test.join(fitted, F.col(prob).eqNullSafe(F.col("_x")), "left").drop("_x")


def platt_fit(train: DataFrame, prob: str = "risk", label: str = "label", c: float = 1.0,
              tolerance: float = 1e-10, steps: int = 100) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve over the score that minimises the log loss
    plus slope^2 / (2 c).

    Newton's method: each step is one aggregation of the folded rows into gradient and
    Hessian.  A step that would raise the loss is halved; all halvings are tried in the
    same pass.  Raises when ``steps`` steps leave a gradient above ``tolerance`` a row.
    """
    folded = _score_label_counts(train, prob, label)
    x, y, w = F.col("x"), F.col("y"), F.col("w")

    def loss(slope: float, intercept: float) -> Column:
        z = F.lit(slope) * x + F.lit(intercept)
        # ln(1 + exp(z)) - y z without overflow
        return F.sum(w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)) + F.lit(slope * slope / (2 * c))

    def derivatives(slope: float, intercept: float) -> list[Column]:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * x + F.lit(intercept))))
        q = w * p * (F.lit(1.0) - p)
        return [F.sum(e).alias(n) for n, e in (
            ("n", w), ("ga", w * (p - y) * x), ("gb", w * (p - y)), ("haa", q * x * x), ("hab", q * x), ("hbb", q))]

    a = b = 0.0
    for _ in range(steps):
        d = folded.agg(*derivatives(a, b)).first()
        if not d["n"]:
            return 0.0, 0.0
        ga, haa = d["ga"] + a / c, d["haa"] + 1 / c
        if max(abs(ga), abs(d["gb"])) <= tolerance * d["n"]:
            return a, b
        # one class only: the intercept runs off, a tiny ridge keeps the system regular
        hbb = d["hbb"] + 1e-12
        det = haa * hbb - d["hab"] ** 2
        da, db = (hbb * ga - d["hab"] * d["gb"]) / det, (haa * d["gb"] - d["hab"] * ga) / det
        tried = [(a - da / 2**i, b - db / 2**i) for i in range(12)]
        losses = folded.agg(loss(a, b).alias("now"), *[loss(*t).alias(f"t{i}") for i, t in enumerate(tried)]).first()
        better = [i for i in range(len(tried)) if losses[f"t{i}"] <= losses["now"] + 1e-12 * abs(losses["now"])]
        a, b = tried[better[0] if better else -1]
    raise ValueError(f"the fit did not settle in {steps} steps")


def platt_calibrate(train: DataFrame, test: DataFrame, prob: str = "risk",
                    label: str = "label", out: str = "platt", c: float = 1.0) -> DataFrame:
    """Logistic recalibration of the score, fitted on ``train``."""
    slope, intercept = platt_fit(train, prob, label, c)
    return test.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col(prob) + F.lit(intercept)))))
