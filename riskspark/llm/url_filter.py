"""URL filters: listed rules decide first, boosted trees on lexical features the rest.

Everything is DataFrame code: the parts of a URL and its features are column
expressions, the trees come from Spark's own gradient boosting.  A URL is judged in
one narrow stage, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, lower_ascii

FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "symbol_ratio",
            "host_digits", "hyphens", "entropy", "params", "has_fragment", "longest_label", "suffix_block",
            "suffix_seen"]

# Number of labelled URLs that the trees are fitted on at most (a hash of the URL picks).
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Rule:
    """``rule`` is a host, a slash and the start of a path, like ``org/`` or ``com/de/``."""

    verdict: str
    rule: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null and where there is no ``://``."""
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does.  The list
    is a parameter of at most some hundred entries; it becomes one CASE expression."""
    chosen = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        rule_host, slash, rest = r.rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        value = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character.  Distinct characters of one URL: a short list, not the table."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(c: Column) -> Column:
        return F.size(F.filter(chars, lambda x: x == c)) / n

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - F.when(
        c == "", F.lit(0.0)).otherwise(share(c) * F.log2(share(c))))


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def with_features(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the columns of FEATURES."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    joined = urls.withColumn("_suffix", suffix(host)).join(suffixes, "_suffix", "left")
    return joined.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "depth": _count(path, "/[^/]"),
        "host_labels": _count(host, r"[^.]+"), "digit_ratio": _count(url, "[0-9]") / n,
        "symbol_ratio": _count(url, r"[^A-Za-z0-9]") / n, "host_digits": _count(host, "[0-9]"),
        "hyphens": _count(host, "-"), "entropy": _entropy(url), "params": _count(url, "[?&][^=&#]+="),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))),
                                    F.lit(0)).cast("double"),
        "suffix_block": F.coalesce(F.col("_block"), F.lit(0.5)),
        "suffix_seen": F.log1p(F.coalesce(F.col("_seen"), F.lit(0)).cast("double")),
    }).drop("_suffix", "_block", "_seen")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(_suffix, _block, _seen): smoothed share of blocked URLs and their number per
    suffix, over all labelled URLs."""
    return labelled.groupBy(suffix(F.col("host")).alias("_suffix")).agg(
        ((F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("_block"), F.count(F.lit(1)).alias("_seen"))


def fit_trees(labelled: DataFrame, suffixes: DataFrame, trees: int = 12, depth: int = 4,
              fit_rows: int = FIT_ROWS, seed: int = 7) -> PipelineModel | None:
    """Boosted trees from ``labelled`` (url, host, path, label 0.0/1.0).

    None if the labels hold fewer than two classes.  At most ``fit_rows`` rows are
    fitted: those whose hash of the URL is smallest, so the choice depends on the
    rows only.
    """
    sample = labelled.select("url", "host", "path", "label").orderBy(F.xxhash64("url"), "url").limit(fit_rows)
    rows = Scratch(labelled.sparkSession, "urls").store(with_features(sample, suffixes), "fit")
    if rows.select("label").distinct().count() < 2:
        return None
    parts = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    trees_ = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3,
                           seed=seed)
    return PipelineModel(stages=[parts, trees_.fit(parts.transform(rows))])


def judge_urls(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, id_col: str = "page_id",
               url_col: str = "url", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    * URLs that a rule decides are the labelled ones; the trees learn from them and
      judge the others (``score``: their probability of "block").
    * A null URL, or one without ``://``, has an empty host and path and fits no rule.
    * Without labels of both classes the rest goes by the only class, or is allowed.
    * Repeated rows each get a result; an empty table gives none.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = url_parts(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path})
    urls = urls.withColumn("_r", first_rule(F.col("host"), F.col("path"), rules))
    urls = urls.select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_v"))
    labelled = urls.filter(F.col("rule").isNotNull()).withColumn("label", (F.col("_v") == "block").cast("double"))
    suffixes = Scratch(pages.sparkSession, "urls").store(suffix_statistics(labelled), "suffixes")
    model = fit_trees(labelled, suffixes, fit_rows=fit_rows)
    if model is None:
        blocked = labelled.filter("label = 1").limit(1).count() > 0
        scored = urls.withColumn("score", F.lit(1.0 if blocked else 0.0))
    else:
        scored = model.transform(with_features(urls, suffixes)).withColumn(
            "score", vector_to_array("probability")[1])
    guess = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_v", guess).alias("verdict"), "score")
