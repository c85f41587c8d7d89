"""Text rewrites of the evasion study, and what they cost each detector."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K
from . import metrics as M, scoring
from .scoring import RiskModel


def java_replacement(template: str) -> str:
    """``\\1`` references as Java writes them, everything else literal."""
    out = ""
    for part in re.split(r"(\\[0-9])", template):
        if re.fullmatch(r"\\[0-9]", part):
            out += "$" + part[1]
        else:
            out += part.replace("\\", "\\\\").replace("$", "\\$")
    return out


def benign_camouflage(text: Column) -> Column:
    """A fixed benign header instead of the first ``#!`` line."""
    body = F.when(text.startswith("#!"), F.regexp_replace(text, r"\A[^\n]*\n?", "")).otherwise(text)
    return F.concat(F.lit(K.BENIGN_HEADER), body)


def lexical_disguise(text: Column) -> Column:
    for pattern, word in K.HOST_DISGUISE:
        text = F.regexp_replace(text, pattern, java_replacement(word))
    return text


def both(text: Column) -> Column:
    return lexical_disguise(benign_camouflage(text))


def substitution(name: str):
    """The rewrite ``name`` as a column function."""
    pattern, template = next((p, t) for n, p, t in K.SUBSTITUTIONS if n == name)
    return lambda text: F.regexp_replace(text, pattern, java_replacement(template))


rm_to_find = substitution("rm_to_find")
nc_to_socat = substitution("nc_to_socat")
devtcp_to_socat = substitution("devtcp_to_socat")
curlpipe_to_staged = substitution("curlpipe_to_staged")
curl_to_python = substitution("curl_to_python")


def apply_all(text: Column) -> Column:
    for name, _, _ in K.SUBSTITUTIONS:
        text = substitution(name)(text)
    return text


DISGUISES = {"benign_camouflage": benign_camouflage, "lexical_disguise": lexical_disguise, "both": both}
ATTACKS = {**{name: substitution(name) for name, _, _ in K.SUBSTITUTIONS}, "all_transforms": apply_all}


def variants(df: DataFrame, rewrites: dict, text: str = "script") -> DataFrame:
    """One row per text and rewrite, with ``variant``; ``original`` is the text itself."""
    t = F.col(text)
    entries = [F.struct(F.lit("original").alias("variant"), t.alias(text))]
    entries += [F.struct(F.lit(n).alias("variant"), fn(t).alias(text)) for n, fn in rewrites.items()]
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(F.array(*entries)).alias("_v")).select(*rest, "_v.*")


def variant_predictions(df: DataFrame, rewrites: dict, models: dict[str, RiskModel],
                        keep: list[str] = ["id", "label", "variant"]) -> DataFrame:
    """Decisions of every model on every variant of the dangerous rows."""
    from .learning import predictions_of

    dangerous = df.filter("label = 1").select("id", "label", "script")
    return predictions_of(scoring.features_for(variants(dangerous, rewrites)), models, keep)


def variant_recall(df: DataFrame, model: RiskModel = RiskModel(), rewrites: dict = DISGUISES) -> DataFrame:
    """Recall per variant and its drop from the original text."""
    return M.recall_by_variant(variant_predictions(df, rewrites, {"model": model}))


def evasion_budget(df: DataFrame, models: dict[str, RiskModel], rewrites: dict = ATTACKS) -> DataFrame:
    """Recall per detector and rewrite; ``all_transforms`` is the largest budget."""
    pred = variant_predictions(df, rewrites, models)
    return M.recall_by_variant(pred.withColumnRenamed("config", "detector"), ["detector"])
