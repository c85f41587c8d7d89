"""Thirteen features, a logistic risk, four trust levels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import context, fixed as K, lexical
from . import signatures


@dataclass(frozen=True)
class RiskModel:
    """Weights, bias, decision threshold, and the feature groups switched off."""

    weights: dict = field(default_factory=lambda: dict(K.DEFAULT_WEIGHTS))
    bias: float = K.DEFAULT_BIAS
    threshold: float = K.DEFAULT_THRESHOLD
    disabled: tuple = ()

    @property
    def features(self) -> list[str]:
        off = {f for g in self.disabled for f in K.FEATURE_GROUPS[g]}
        return [f for f in K.FEATURES if f not in off]


def _binary(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def build_features(df: DataFrame, text: str = "script", threat: bool = True,
                   keep_hits: bool = False) -> DataFrame:
    """Add the 13 feature columns; one narrow projection chain, no shuffle.

    With ``threat=False`` no signature is matched and its features are zero.
    """
    base = df.columns
    parsed = context.extract_context(lexical.parse_scripts(df, text), text)
    if threat:
        parsed = signatures.flag_signatures(parsed, text)
        sums = {f"cat_{c}": signatures.category_sum(c) for c in signatures.CATEGORIES}
        extra = {"hits": signatures.hits_array()} if keep_hits else {}
        parsed = parsed.withColumns({**sums, **extra})
        cats = [F.col(f"cat_{c}") for c in signatures.CATEGORIES]
        total = F.lit(0.0)
        positive = F.lit(0)
        for c in cats:
            total = total + c
            positive = positive + F.when(c > 0, 1).otherwise(0)
        top = F.greatest(F.lit(0.0), *cats)
        threat_cols = {
            "threat_weight_norm": F.least(
                F.lit(1.0), F.greatest(F.lit(0.0), total) / K.SIGNATURE_WEIGHT_SCALE),
            "threat_max_category_norm": F.least(F.lit(1.0), top / K.CATEGORY_WEIGHT_SCALE),
            "threat_distinct_categories": positive / F.lit(K.CATEGORY_COUNT_SCALE),
        }
    else:
        threat_cols = {f: F.lit(0.0) for f in K.FEATURE_GROUPS["threat"]}
        if keep_hits:
            parsed = parsed.withColumn("hits", F.array().cast(signatures.HIT_TYPE))
    c = F.col
    density = F.when(
        c("line_count") > 0,
        c("command_substitutions") / F.greatest(F.lit(1), c("line_count"))).otherwise(F.lit(0.0))
    out = parsed.withColumns({
        "semantic_pipes_to_shell": _binary(c("pipes_to_shell")),
        "semantic_has_destructive_cmd": _binary(
            context.has_command(c("commands"), K.SCORING_DESTRUCTIVE)),
        "semantic_has_network_cmd": _binary(
            context.has_command(c("commands"), K.SCORING_NETWORK)),
        "semantic_has_device_target": _binary(F.size("devices") > 0),
        "semantic_cmd_substitution_density": F.least(F.lit(1.0), density),
        **threat_cols,
    })
    kept = lexical.PARSED_COLUMNS + ["hits"] if keep_hits else []
    return out.select(*base, *[k for k in kept if k not in base], *K.FEATURES)


def features_for(df: DataFrame, text: str = "script") -> DataFrame:
    return build_features(df, text)


def logit(model: RiskModel) -> Column:
    z = F.lit(float(model.bias))
    for name in model.features:
        z = z + F.lit(float(model.weights[name])) * F.col(name)
    return z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def trust_level(risk: Column) -> Column:
    (b0, l0), *rest = K.LEVEL_BOUNDS
    level = F.when(risk < b0, l0)
    for bound, name in rest:
        level = level.when(risk < bound, name)
    return level.otherwise(K.TOP_LEVEL)


def decide(risk: Column, threshold: float) -> Column:
    return risk >= F.lit(float(threshold))


def score(features: DataFrame, model: RiskModel = RiskModel()) -> DataFrame:
    """Add logit, risk, trust, level and decision to a feature frame."""
    return (
        features.withColumn("logit", logit(model))
        .withColumn("risk", sigmoid(F.col("logit")))
        .withColumns({
            "trust": F.lit(1.0) - F.col("risk"),
            "level": trust_level(F.col("risk")),
            "dangerous": decide(F.col("risk"), model.threshold),
        })
    )


def contributions(features: DataFrame, model: RiskModel = RiskModel()) -> DataFrame:
    """Long form: one row per (id, enabled feature) with weight times value."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 (F.lit(float(model.weights[f])) * F.col(f)).alias("contribution"))
        for f in model.features])
    return features.select("id", F.explode(pairs).alias("p")).select("id", "p.*")


def ablate(df: DataFrame, groups: list[str], model: RiskModel = RiskModel(),
           text: str = "script") -> DataFrame:
    """Score with some feature groups switched off.  Columns of a disabled group
    are not read, so Catalyst removes the work behind them."""
    off = RiskModel(model.weights, model.bias, model.threshold, tuple(groups))
    return score(build_features(df, text, threat="threat" not in groups), off)


def analyze(df: DataFrame, model: RiskModel = RiskModel(), policy: bool = True,
            text: str = "script") -> DataFrame:
    """Parse, extract context, match, featurise, score and attach the policy."""
    from .policy import attach_policy

    scored = score(build_features(df, text, threat="threat" not in model.disabled,
                                  keep_hits=True), model)
    return attach_policy(scored) if policy else scored


def model_table(spark: SparkSession, model: RiskModel = RiskModel(),
                model_id: str = "default") -> DataFrame:
    """(model_id, feature, weight) rows; ``bias`` and ``threshold`` are rows too."""
    rows = [(model_id, f, float(model.weights[f])) for f in K.FEATURES]
    rows += [(model_id, "bias", float(model.bias)), (model_id, "threshold", float(model.threshold))]
    return spark.createDataFrame(rows, "model_id string, feature string, weight double")


def override_model(default: DataFrame, override: DataFrame) -> DataFrame:
    """A default model table with some weights replaced."""
    new = override.select("feature", F.col("weight").alias("new_weight"))
    return default.join(new, "feature", "left").select(
        "model_id", "feature", F.coalesce("new_weight", "weight").alias("weight"))


def read_model(table: DataFrame, disabled: tuple = (), model_id: str | None = None) -> RiskModel:
    """Load a 15-row model table back into plan-time literals.

    ``model_id`` picks one of several models; a feature that stands twice is an error.
    """
    rows = table if model_id is None else table.filter(F.col("model_id") == model_id)
    known = rows.filter(F.col("feature").isin(*K.FEATURES, "bias", "threshold"))
    found = known.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.any_value("weight").alias("weight")).collect()
    if any(r["n"] > 1 for r in found):
        raise ValueError("the table holds several models: pass model_id")
    values = {r["feature"]: r["weight"] for r in found}
    weights = {f: values.get(f, K.DEFAULT_WEIGHTS[f]) for f in K.FEATURES}
    return RiskModel(weights, values.get("bias", K.DEFAULT_BIAS),
                     values.get("threshold", K.DEFAULT_THRESHOLD), disabled)
