"""Fitting the logistic risk model.

Full-batch gradient descent.  Feature vectors repeat a lot, so the corpus folds
into distinct (features, label) rows with a count first; every epoch is one
aggregation over that table, for any number of models at once (ablations, folds),
and brings back 15 numbers per model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed as K
from ..session import checkpointed, stored
from . import metrics as M, scoring, splits
from .scoring import RiskModel

EPS = 1e-12
# The mean gradient replaces one step per row, hence a larger rate than the 0.3
# of single-example updates.
BATCH_RATE = 2.0
STEP_RATE = 0.3
L2 = 1e-3


@dataclass
class Training:
    """A fitted model with its loss per epoch and the norm of its total change."""

    model: RiskModel
    losses: list = field(default_factory=list)
    weight_delta_norm: float = 0.0


def bce(p: Column, y: Column) -> Column:
    q = F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), p))
    return -(y * F.ln(q) + (F.lit(1) - y) * F.ln(F.lit(1) - q))


def bce_loss(scored: DataFrame, keys: list[str] = [], prob: str = "risk",
             label: str = "label") -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(bce(F.col(prob), F.col(label))).alias("loss"))


def gradient(features: DataFrame, model: RiskModel = RiskModel(), label: str = "label") -> DataFrame:
    """One row: the summed gradient per feature (``g_<feature>``), of the bias
    (``g_bias``), and the row count."""
    err = F.col("_err")
    rows = features.withColumn("_err", scoring.sigmoid(scoring.logit(model)) - F.col(label))
    return rows.agg(*[F.sum(err * F.col(f)).alias(f"g_{f}") for f in K.FEATURES],
                    F.sum(err).alias("g_bias"), F.count(F.lit(1)).alias("n"))


def fold_rows(features: DataFrame, extra: list[str] = [], label: str = "label") -> DataFrame:
    """Distinct (extra, label, features) rows with their count ``n``."""
    return features.groupBy(*extra, label, *K.FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n"))


def _model_rows(models: dict[str, RiskModel], held: dict) -> Column:
    """The models as one literal array: numbers stay out of the generated code, so
    all epochs share one compiled stage."""
    def row(name: str, m: RiskModel) -> Column:
        on = set(m.features)
        return F.struct(
            F.lit(name).alias("name"), F.lit(float(m.bias)).alias("bias"),
            F.array(*[F.lit(float(m.weights[f]) if f in on else 0.0) for f in K.FEATURES]).alias("w"),
            F.lit(int(held.get(name, -1))).alias("held"))

    return F.array(*[row(n, m) for n, m in models.items()])


def fit_many(table: DataFrame, starts: dict[str, RiskModel], epochs: int, lr: float = BATCH_RATE,
             l2: float = L2, label: str = "label", fold: str | None = None,
             held: dict | None = None) -> dict[str, Training]:
    """Fit several models in lockstep on a folded table: one aggregation per epoch.

    With ``fold``, model ``name`` leaves out the rows whose fold is ``held[name]``.
    Weights of disabled groups stay as they are; the bias is not regularised.
    """
    runs = {name: Training(start) for name, start in starts.items()}
    held = held or {}
    w, x = F.col("m.w"), {f: F.col(f) for f in K.FEATURES}
    for _ in range(epochs):
        rows = table.withColumn("m", F.explode(_model_rows({n: r.model for n, r in runs.items()}, held)))
        if fold is not None:
            rows = rows.filter(F.col(fold) != F.col("m.held"))
        z = F.col("m.bias")
        for i, f in enumerate(K.FEATURES):
            z = z + w[i] * x[f]
        rows = rows.withColumn("p", scoring.sigmoid(z)).withColumn(
            "err", (F.col("p") - F.col(label)) * F.col("n"))
        sums = rows.groupBy(F.col("m.name").alias("name")).agg(
            *[F.sum(F.col("err") * x[f]).alias(f) for f in K.FEATURES],
            F.sum("err").alias("bias"), F.sum("n").alias("n"),
            F.sum(bce(F.col("p"), F.col(label)) * F.col("n")).alias("loss"))
        for row in sums.collect():  # one row of 17 numbers per model
            run, n = runs[row["name"]], row["n"]
            old = run.model
            weights = dict(old.weights)
            for f in old.features:
                weights[f] -= lr * (row[f] / n + l2 * weights[f])
            run.losses.append(row["loss"] / n)
            run.model = RiskModel(weights, old.bias - lr * row["bias"] / n, old.threshold, old.disabled)
    for name, start in starts.items():
        end = runs[name].model
        change = sum((end.weights[f] - start.weights[f]) ** 2 for f in K.FEATURES)
        runs[name].weight_delta_norm = math.sqrt(change + (end.bias - start.bias) ** 2)
    return runs


def train(features: DataFrame, epochs: int = 40, lr: float = BATCH_RATE, l2: float = L2,
          start: RiskModel = RiskModel(), label: str = "label") -> Training:
    table = checkpointed(fold_rows(features, label=label))
    return fit_many(table, {"model": start}, epochs, lr, l2, label)["model"]


def training_log(spark: SparkSession, run: Training) -> DataFrame:
    return spark.createDataFrame(
        [(i + 1, float(x)) for i, x in enumerate(run.losses)], "epoch int, loss double")


def tuned(folded: DataFrame, model: RiskModel, target: str = "f1", max_fpr: float = 0.05,
          label: str = "label") -> RiskModel:
    """``model`` with the best threshold on a folded training table."""
    best = M.tune_threshold(scoring.score(folded, model), target, max_fpr, label=label, weight="n").first()
    return RiskModel(model.weights, model.bias, best["threshold"], model.disabled)


def _with_features(df: DataFrame) -> DataFrame:
    return df if K.FEATURES[0] in df.columns else scoring.features_for(df)


def train_and_eval(train_rows: DataFrame, test_rows: DataFrame, disabled: tuple = (),
                   use_feedback: bool = True, tune: bool = True, epochs: int = 40,
                   lr: float = BATCH_RATE, l2: float = L2) -> DataFrame:
    """Metric row of one configuration: fit and tune on ``train_rows`` only."""
    return run_configs(train_rows, test_rows, [("model", tuple(disabled), use_feedback)],
                       tune, epochs, lr, l2)


def fit_configs(train_rows: DataFrame, configs: list[tuple[str, tuple, bool]], tune: bool = True,
                epochs: int = 40, lr: float = BATCH_RATE, l2: float = L2) -> dict[str, Training]:
    table = checkpointed(fold_rows(_with_features(train_rows)))
    learners = {name: RiskModel(disabled=off) for name, off, learn in configs if learn}
    runs = fit_many(table, learners, epochs, lr, l2) if learners else {}
    for name, off, learn in configs:
        if not learn:
            runs[name] = Training(RiskModel(disabled=off))
        elif tune:
            runs[name].model = tuned(table, runs[name].model)
    return runs


def predictions_of(rows: DataFrame, models: dict[str, RiskModel], keep: list[str]) -> DataFrame:
    """Long form (keep, config, risk, predicted): all models in one pass over the rows."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("config"), scoring.sigmoid(scoring.logit(m)).alias("risk"),
                 F.lit(float(m.threshold)).alias("threshold"))
        for name, m in models.items()])
    long = rows.select(*keep, F.explode(entries).alias("c")).select(*keep, "c.*")
    return long.withColumn("predicted", F.col("risk") >= F.col("threshold"))


def config_predictions(features: DataFrame, keep: list[str] = ["id", "label"]) -> DataFrame:
    """The four ablations at default weights, long form."""
    models = {name: RiskModel(disabled=tuple(off)) for name, off in K.ABLATIONS}
    return predictions_of(features, models, keep)


def run_configs(train_rows: DataFrame, test_rows: DataFrame, configs: list[tuple[str, tuple, bool]],
                tune: bool = True, epochs: int = 40, lr: float = BATCH_RATE, l2: float = L2) -> DataFrame:
    runs = fit_configs(train_rows, configs, tune, epochs, lr, l2)
    test = fold_rows(_with_features(test_rows))
    pred = predictions_of(test, {n: r.model for n, r in runs.items()}, ["label", "n"])
    table = M.full_metrics(pred, ["config"], weight="n")
    log = test.sparkSession.createDataFrame(
        [(n, float(r.model.threshold), r.losses[0] if r.losses else None,
          r.losses[-1] if r.losses else None, float(r.weight_delta_norm)) for n, r in runs.items()],
        "config string, decision_threshold double, initial_loss double, final_loss double, "
        "weight_delta_norm double")
    return table.join(F.broadcast(log), "config")  # one row per configuration


def with_f1_delta(table: DataFrame, base: str = "full") -> DataFrame:
    from ..functions.tables import with_row

    # one row per configuration, written once: the delta reads it twice
    table = checkpointed(table)
    full = table.filter(F.col("config") == base).select(F.col("f1").alias("_full"))
    return with_row(table, full).withColumn("delta_f1", F.col("f1") - F.col("_full")).drop("_full")


def run_ablation(train_rows: DataFrame, test_rows: DataFrame, epochs: int = 40) -> DataFrame:
    """full, one feature group off at a time, and no learning; fitted alike."""
    configs = [(name, tuple(off), True) for name, off in K.ABLATIONS] + [("no_feedback", (), False)]
    return with_f1_delta(run_configs(train_rows, test_rows, configs, epochs=epochs))


def ablation_table(features: DataFrame) -> DataFrame:
    """The same masks at default weights."""
    return with_f1_delta(M.classification_metrics(config_predictions(features), ["config"]))


def cross_validate(features: DataFrame, folds: DataFrame, k: int, epochs: int = 40,
                   lr: float = BATCH_RATE, l2: float = L2) -> tuple[DataFrame, DataFrame]:
    """(per-fold metrics, out-of-fold rows) at the fixed threshold 0.5.

    ``folds`` is (id, fold).  All k models are fitted together, model i on the
    rows outside fold i; each row is then scored by the model of its own fold.
    """
    rows = features.join(folds.select("id", "fold"), "id")
    table = checkpointed(fold_rows(rows, ["fold"]))
    runs = fit_many(table, {str(i): RiskModel() for i in range(k)}, epochs, lr, l2,
                    fold="fold", held={str(i): i for i in range(k)})
    risk = F.lit(None).cast("double")
    for i in range(k):
        risk = F.when(F.col("fold") == i, scoring.sigmoid(scoring.logit(runs[str(i)].model))).otherwise(risk)
    oof = rows.withColumn("risk", risk).withColumn("predicted", F.col("risk") >= 0.5).select(
        "id", "label", "fold", "risk", "predicted")
    return M.full_metrics(oof, ["fold"]), oof


def holdout_eval(holdout: DataFrame, model: RiskModel) -> DataFrame:
    """Per-row table of a frozen model on another corpus; errors are the rows
    where ``correct`` is false."""
    scored = scoring.score(_with_features(holdout), model)
    predicted = F.col("dangerous").cast("int")
    return scored.select("id", "category", "label", "risk", predicted.alias("predicted"),
                         (predicted == F.col("label")).alias("correct"))


def external_fpr(benign: DataFrame, models: dict[str, RiskModel]) -> DataFrame:
    """Flagged benign rows per detector with a Wilson interval."""
    return flagged_share(predictions_of(_with_features(benign).filter("label = 0"), models, ["id"]), "config")


def flagged_share(pred: DataFrame, detector: str) -> DataFrame:
    """detector, n_flagged, n_benign, fpr and its Wilson interval of predictions on benign rows."""
    from .stats import wilson_interval

    counts = pred.groupBy(F.col(detector).alias("detector")).agg(
        F.count_if("predicted").alias("n_flagged"), F.count(F.lit(1)).alias("n_benign"))
    return wilson_interval(counts, "n_flagged", "n_benign").withColumn(
        "fpr", F.round(F.col("wilson_point"), 3)).drop("wilson_point")


def online_step(table: DataFrame, model: RiskModel, lr: float = STEP_RATE, l2: float = L2) -> RiskModel:
    """One mean-gradient step on a folded table."""
    return fit_many(table, {"m": model}, 1, lr, l2)["m"].model


def concept_drift(features: DataFrame, category: str = "obfuscated", epochs: int = 40,
                  passes: int = 5, lr: float = BATCH_RATE) -> DataFrame:
    """Recall on a category the model has not seen, frozen and after ``passes``
    passes over the even-numbered half of its dangerous rows."""
    from ..functions import ranking
    from ..functions.tables import with_row

    base = checkpointed(fold_rows(features.filter(F.col("category") != category)))
    model = tuned(base, fit_many(base, {"m": RiskModel()}, epochs, lr)["m"].model)
    novel = features.filter((F.col("category") == category) & (F.col("label") == 1))
    # ids end in a running number, so their digest cuts them evenly
    novel = ranking.ranked(novel.withColumn("_md5", F.md5("id")), [],
                           ranking.hash_bucket(F.col("_md5")), [F.col("_md5"), F.col("id")], "_rank")
    adapt = novel.filter(F.col("_rank") % 2 == 1)
    held = novel.filter(F.col("_rank") % 2 == 0)
    table = checkpointed(fold_rows(adapt))
    online = fit_many(table, {"m": model}, passes, lr)["m"].model
    counts = held.agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.avg((scoring.sigmoid(scoring.logit(model)) >= model.threshold).cast("double")).alias("frozen_recall"),
        F.avg((scoring.sigmoid(scoring.logit(online)) >= model.threshold).cast("double")).alias("online_recall"))
    sizes = table.agg(F.sum("n").cast("bigint").alias("n_adapt"))
    n_base = base.agg(F.sum("n").cast("bigint").alias("n_base_train"))
    return with_row(with_row(counts, sizes), n_base).select(
        F.lit(category).alias("drift_category"), "n_base_train", "n_adapt", "n_eval",
        "frozen_recall", "online_recall", (F.col("online_recall") - F.col("frozen_recall")).alias("recall_recovered"))


def flips_to_safe(features: DataFrame, model: RiskModel = RiskModel(), max_k: int = 50,
                  lr: float = STEP_RATE, l2: float = L2) -> DataFrame:
    """Per dangerous row: how many updates with its own features labelled safe push
    its risk below the threshold (0: already below, null: more than ``max_k``).
    A fold over an array per row; rows are independent.
    """
    names = model.features
    x = F.array(*[F.col(f) for f in names])
    w0 = F.array(*[F.lit(float(model.weights[f])) for f in names])

    def risk_of(w: Column, b: Column) -> Column:
        terms = F.zip_with(w, F.col("_x"), lambda a, c: a * c)
        return scoring.sigmoid(F.aggregate(terms, b, lambda acc, t: acc + t))

    def state(w: Column, b: Column, risk: Column, flip: Column) -> Column:
        return F.struct(w.alias("w"), b.alias("b"), risk.alias("risk"), flip.alias("flip"))

    def update(acc: Column, k: Column) -> Column:
        p = acc["risk"]  # label 0: the error is the risk itself
        w = F.zip_with(acc["w"], F.col("_x"), lambda a, c: a - F.lit(lr) * (p * c + F.lit(l2) * a))
        b = acc["b"] - F.lit(lr) * p
        risk = risk_of(w, b)
        flip = F.when(acc["flip"].isNotNull(), acc["flip"]).when(risk < model.threshold, k)
        return state(w, b, risk, flip)

    rows = features.filter("label = 1").withColumn("_x", x)
    first = risk_of(w0, F.lit(float(model.bias)))
    rows = rows.withColumn("start_risk", first)
    start = state(w0, F.lit(float(model.bias)), F.col("start_risk"), F.lit(None).cast("int"))
    flips = F.aggregate(F.sequence(F.lit(1), F.lit(max_k)), start, update, lambda acc: acc["flip"])
    flips = F.when(F.col("start_risk") < model.threshold, F.lit(0)).otherwise(flips)
    return rows.select("id", "category", "template", "start_risk", flips.alias("updates_to_flip"))


def fit_on(train_rows: DataFrame, epochs: int = 40) -> RiskModel:
    """Fit and tune the full model on a whole corpus."""
    return fit_configs(train_rows, [("full", (), True)], True, epochs)["full"].model


def split_frames(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows.  The split is written once, and both sides are dealt to all cores
    again: splits sized for bytes read would leave too many scripts to one task."""
    marked = stored(splits.stratified_split(rows), "split")
    n = rows.sparkSession.sparkContext.defaultParallelism
    return tuple(marked.filter(F.col("split") == side).repartition(n, "id") for side in ("train", "test"))
