"""Detection metrics.  Label 1 (dangerous) is the positive class everywhere.

Every metric first folds rows into counts (per key, score or category), so what
is shuffled or ordered never grows with the corpus itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ranking
from ..functions.tables import with_row
from ..session import checkpointed

METRICS = ["precision", "recall", "f1", "mcc", "accuracy", "false_positive_rate",
           "false_negative_rate", "specificity"]


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 where the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def _count(condition: Column, weight: str | None) -> Column:
    """Rows meeting ``condition``; ``weight`` names a column of row counts."""
    if weight is None:
        return F.count_if(condition)
    return F.sum(F.when(condition, F.col(weight)).otherwise(0)).cast("bigint")


def confusion(pred: DataFrame, keys: list[str] = [], label: str = "label",
              predicted: str = "predicted", weight: str | None = None) -> DataFrame:
    """tp, fp, tn, fn per key."""
    y, p = F.col(label) == 1, F.col(predicted).cast("int") == 1
    return pred.groupBy(*keys).agg(
        _count(y & p, weight).alias("tp"), _count(~y & p, weight).alias("fp"),
        _count(~y & ~p, weight).alias("tn"), _count(y & ~p, weight).alias("fn"))


def metrics_from_counts(cells: DataFrame) -> DataFrame:
    """Add the metric bundle to a frame with tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    with_rates = cells.withColumns({
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "mcc": ratio(tp * tn - fp * fn,
                     F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
        "specificity": ratio(tn, tn + fp),
        "n": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"),
        "positives": F.col("tp") + F.col("fn"),
        "negatives": F.col("fp") + F.col("tn"),
    })
    p, r = F.col("precision"), F.col("recall")
    return with_rates.withColumn("f1", ratio(F.lit(2.0) * p * r, p + r))


def classification_metrics(pred: DataFrame, keys: list[str] = [], label: str = "label",
                           predicted: str = "predicted", weight: str | None = None) -> DataFrame:
    return metrics_from_counts(confusion(pred, keys, label, predicted, weight))


def full_metrics(pred: DataFrame, keys: list[str], score: str = "risk", label: str = "label",
                 predicted: str = "predicted", weight: str | None = None) -> DataFrame:
    """The metric bundle with roc_auc and pr_auc per key.

    Predictions fold to one weighted row per (key, label, score, decision), written
    once; both halves read that table.
    """
    unit = F.lit(1) if weight is None else F.col(weight)
    folded = checkpointed(pred.groupBy(*keys, label, score, predicted).agg(F.sum(unit).alias("_k")))
    return classification_metrics(folded, keys, label, predicted, "_k").join(
        ranking_metrics(folded, keys, score, label, "_k"), keys)


# -- curves ------------------------------------------------------------------
def score_counts(scored: DataFrame, keys: list[str] = [], score: str = "risk",
                 label: str = "label", weight: str | None = None) -> DataFrame:
    """(score, pos, neg) per distinct score with totals at or above it.

    One aggregation reads the rows; ordering happens on distinct scores, cut into
    score buckets, so no class is ever sorted in one task.
    """
    counts = scored.groupBy(*keys, F.col(score).alias("score")).agg(
        _count(F.col(label) == 1, weight).alias("pos"), _count(F.col(label) == 0, weight).alias("neg"))
    return ranking.running(counts, keys, ranking.score_bucket(F.col("score")), "score",
                           ["pos", "neg"], descending=True)


def _with_anchor(curve: DataFrame, keys: list[str], point: Column, anchor: Column) -> DataFrame:
    """The curve's points, and ``anchor`` next to the highest score of each key."""
    highest = (F.col("cum_pos") - F.col("pos") + F.col("cum_neg") - F.col("neg")) == 0
    both = F.when(highest, F.array(anchor, point)).otherwise(F.array(point))
    return curve.select(*keys, F.explode(both).alias("p")).select(*keys, "p.*")


def roc_curve(scored: DataFrame, keys: list[str] = [], score: str = "risk",
              label: str = "label") -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score, plus the (0, 0) start."""
    c = F.col
    point = F.struct(ratio(c("cum_neg"), c("all_neg")).alias("fpr"),
                     ratio(c("cum_pos"), c("all_pos")).alias("tpr"), c("score").alias("threshold"))
    start = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                     F.lit(float("inf")).alias("threshold"))
    return _with_anchor(score_counts(scored, keys, score, label), keys, point, start)


def pr_curve(scored: DataFrame, keys: list[str] = [], score: str = "risk",
             label: str = "label") -> DataFrame:
    """(precision, recall, threshold) at every distinct score, plus (1, 0)."""
    c = F.col
    point = F.struct((c("cum_pos") / (c("cum_pos") + c("cum_neg"))).alias("precision"),
                     ratio(c("cum_pos"), c("all_pos")).alias("recall"), c("score").alias("threshold"))
    end = F.struct(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                   F.lit(None).cast("double").alias("threshold"))
    return _with_anchor(score_counts(scored, keys, score, label), keys, point, end)


def ranking_metrics(scored: DataFrame, keys: list[str] = [], score: str = "risk",
                    label: str = "label", weight: str | None = None) -> DataFrame:
    """roc_auc and pr_auc per key; null with one class only.

    Trapezoids as plain sums over the score table.  ROC: a distinct score adds
    neg * (positives above + pos / 2).  Precision over recall, anchored at
    (recall 0, precision 1): the previous point is the total above this score.
    """
    c = F.col
    prev_pos, prev_neg = c("cum_pos") - c("pos"), c("cum_neg") - c("neg")
    roc_part = c("neg") * (prev_pos.cast("double") + c("pos") / F.lit(2.0))
    here = c("cum_pos") / (c("cum_pos") + c("cum_neg"))
    prev = F.when(prev_pos + prev_neg > 0, prev_pos / (prev_pos + prev_neg)).otherwise(F.lit(1.0))
    pr_part = c("pos") * (here + prev) / F.lit(2.0)
    grouped = score_counts(scored, keys, score, label, weight).groupBy(*keys).agg(
        F.sum(roc_part).alias("_roc"), F.sum(pr_part).alias("_pr"),
        F.max("all_pos").alias("_p"), F.max("all_neg").alias("_n"))
    both = (c("_p") > 0) & (c("_n") > 0)
    return grouped.select(
        *keys, F.when(both, c("_roc") / (c("_p").cast("double") * c("_n"))).alias("roc_auc"),
        F.when(both, c("_pr") / c("_p")).alias("pr_auc"))


def roc_auc(scored: DataFrame, keys: list[str] = [], score: str = "risk",
            label: str = "label") -> DataFrame:
    return ranking_metrics(scored, keys, score, label).select(*keys, "roc_auc")


def pr_auc(scored: DataFrame, keys: list[str] = [], score: str = "risk",
           label: str = "label") -> DataFrame:
    return ranking_metrics(scored, keys, score, label).select(*keys, "pr_auc")


# -- threshold ----------------------------------------------------------------
def tune_threshold(scored: DataFrame, target: str = "f1", max_fpr: float = 0.05,
                   keys: list[str] = [], score: str = "risk", label: str = "label",
                   weight: str | None = None) -> DataFrame:
    """Best decision threshold among the scores rounded to 3 places and 0.5.

    Scores fold into at most 1001 steps of a thousandth, so everything after the
    first aggregation is tiny.  Ties keep the lowest threshold; when nothing
    beats -1 the threshold is 0.5.  ``weight`` names a column of row counts.
    """
    s = F.col(score)
    step = F.floor(s * 1000)
    step = F.when(s >= (step + 1) / F.lit(1000.0), step + 1).when(
        s < step / F.lit(1000.0), step - 1).otherwise(step)
    folded = scored.groupBy(
        *keys, step.cast("int").alias("step"),
        F.bround(s, 3).alias("candidate")
    ).agg(_count(F.col(label) == 1, weight).alias("pos"), _count(F.col(label) == 0, weight).alias("neg"))
    # Each row feeds its own step and announces its candidate (and 0.5).
    none = F.lit(0).cast("bigint")

    def entry(at: Column, pos: Column, neg: Column, candidate: bool) -> Column:
        return F.struct(at.cast("int").alias("step"), pos.alias("pos"), neg.alias("neg"),
                        F.lit(candidate).alias("is_candidate"))

    entries = F.array(
        entry(F.col("step"), F.col("pos"), F.col("neg"), False),
        entry(F.round(F.col("candidate") * 1000), none, none, True),
        entry(F.lit(500), none, none, True))
    steps = folded.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*").groupBy(
        *keys, "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                           F.max("is_candidate").alias("is_candidate"))
    down = Window.partitionBy(*keys).orderBy(F.col("step").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    cells = steps.withColumns({
        "tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down),
        "all_pos": F.sum("pos").over(whole), "all_neg": F.sum("neg").over(whole),
    }).filter("is_candidate").withColumns({
        "fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp"),
        "threshold": F.col("step") / F.lit(1000.0),
    })
    tried = metrics_from_counts(cells)
    if target == "f1":
        tried = tried.withColumn("metric", F.col("f1"))
    else:
        tried = tried.withColumn("metric", F.when(
            F.col("false_positive_rate") <= max_fpr, F.col("recall")).otherwise(F.lit(-1.0)))
    best = tried.groupBy(*keys).agg(F.min_by(
        F.struct("threshold", "metric"), F.struct(-F.col("metric"), F.col("threshold"))).alias("b"))
    return best.select(
        *keys, F.when(F.col("b.metric") > -1, F.col("b.threshold")).otherwise(F.lit(0.5)).alias("threshold"),
        F.col("b.metric").alias("metric"))


# -- tables -------------------------------------------------------------------
def per_category_recall(pred: DataFrame, predicted: str = "predicted") -> DataFrame:
    hit = F.col(predicted).cast("int").cast("double")
    return pred.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("n_dangerous"),
        F.count_if(F.col("label") == 0).alias("n_safe"),
        F.avg(F.when(F.col("label") == 1, hit)).alias("recall_dangerous"),
        F.avg(F.when(F.col("label") == 0, hit)).alias("false_positive_rate_safe"))


def corpus_counts(df: DataFrame) -> DataFrame:
    """Counts by category, by label, and in all."""
    return df.groupingSets(
        [["category"], ["label_name"], []], "category", "label_name"
    ).agg(F.count(F.lit(1)).alias("n"))


def split_summary(df: DataFrame) -> DataFrame:
    """Counts by split and category, with a total row per split."""
    return df.groupingSets([["split", "category"], ["split"]], "split", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 0).alias("n_safe"),
        F.count_if(F.col("label") == 1).alias("n_dangerous"))


def top_risk(scored: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` riskiest dangerous rows."""
    return (scored.filter("label = 1").orderBy(F.col("risk").desc(), "id").limit(n)
            .select("id", "category", "template", "risk"))


def fpr_reduction(a: DataFrame, b: DataFrame, keys: list[str] = []) -> DataFrame:
    """Relative drop of the false-positive rate of ``a`` against ``b``, in percent;
    no row where ``b`` raises no false positive."""
    left = a.select(*keys, F.col("false_positive_rate").alias("fpr_a"))
    right = b.select(*keys, F.col("false_positive_rate").alias("fpr_b")).filter("fpr_b > 0")
    both = left.join(right, keys) if keys else with_row(left, right).filter("fpr_b is not null")
    return both.withColumn("reduction_pct", (F.col("fpr_b") - F.col("fpr_a")) / F.col("fpr_b") * 100.0)


def recall_by_variant(pred: DataFrame, keys: list[str] = [], predicted: str = "predicted",
                      base: str = "original") -> DataFrame:
    """Recall on dangerous rows per text variant and its drop from ``base``."""
    recall = checkpointed(pred.filter("label = 1").groupBy(*keys, "variant").agg(
        F.count(F.lit(1)).alias("n_dangerous"),
        F.avg(F.col(predicted).cast("int").cast("double")).alias("recall")))
    original = recall.filter(F.col("variant") == base).select(*keys, F.col("recall").alias("_base"))
    joined = recall.join(original, keys) if keys else with_row(recall, original)
    return joined.withColumn("drop", F.col("_base") - F.col("recall")).drop("_base")


def latency_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Lowest value per key, then mean, median, nearest-rank p95 and p99, min, max,
    population deviation and rate per second (values in milliseconds)."""
    best = df.groupBy(key).agg(F.min(value).cast("double").alias("ms"))
    stats = best.agg(
        F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"), F.stddev_pop("ms").alias("stdev_ms"))
    hist = best.groupBy("ms").agg(F.count(F.lit(1)).alias("k"))
    cum = ranking.running(hist, [], ranking.value_bucket(F.col("ms")), "ms", ["k"])
    last = F.col("n") - 1
    ranks = {
        "median_lo": F.floor(last / 2), "median_hi": F.ceil(last / 2),
        "p95_ms": F.bround(last * F.lit(0.95)).cast("bigint"),
        "p99_ms": F.bround(last * F.lit(0.99)).cast("bigint"),
    }
    at = with_row(cum, stats.select("n"))
    picked = at.agg(*[
        F.min(F.when(F.col("cum_k") > pos, F.col("ms"))).alias(name) for name, pos in ranks.items()])
    one = with_row(stats, picked)
    return one.select(
        "n", "mean_ms", ((F.col("median_lo") + F.col("median_hi")) / 2).alias("median_ms"),
        "p95_ms", "p99_ms", "min_ms", "max_ms", "stdev_ms",
        ratio(F.lit(1000.0), F.col("mean_ms")).alias("throughput_per_sec"))


def findings_to_decision(corpus: DataFrame, findings: DataFrame) -> DataFrame:
    """Lint findings (id, level) per corpus row: flag on error or warning, flag on
    error alone, number of findings (0 where there is none)."""
    folded = findings.groupBy("id").agg(
        F.bool_or(F.col("level").isin("error", "warning")).alias("flag"),
        F.bool_or(F.col("level") == "error").alias("flag_error"),
        F.count(F.lit(1)).alias("n_findings"))
    return corpus.join(folded, "id", "left").withColumns({
        "flag": F.coalesce("flag", F.lit(False)),
        "flag_error": F.coalesce("flag_error", F.lit(False)),
        "n_findings": F.coalesce("n_findings", F.lit(0)),
    })
