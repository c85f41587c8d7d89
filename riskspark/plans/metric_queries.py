"""Metrics, splits, folds, statistics, calibration, agreement, event decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.hashing import digest, hex_number
from ..operators import agreement, metrics as M, monitor, policy, scoring, splits, stats
from . import sqlbase as Q
from .registry import (SCORED, HOLDOUT, BENIGN, benign, corpus, d6, holdout, query, r6, scored, table)

CELLS = """count(*) FILTER ({y} = 1 AND {p}) AS tp, count(*) FILTER ({y} = 0 AND {p}) AS fp,
  count(*) FILTER ({y} = 0 AND NOT {p}) AS tn, count(*) FILTER ({y} = 1 AND NOT {p}) AS fn"""


def cells(y: str = "label", p: str = "dangerous") -> str:
    return CELLS.format(y=y, p=p)


def metric_exprs(tp="tp", fp="fp", tn="tn", fn="fn") -> dict:
    def ratio(a, b):
        return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"
    p, r = ratio(tp, f"{tp} + {fp}"), ratio(tp, f"{tp} + {fn}")
    return {
        "precision": p, "recall": r,
        "f1": f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)",
        "mcc": f"coalesce(({tp}::DOUBLE * {tn} - {fp}::DOUBLE * {fn}) / nullif(sqrt({tp} + {fp}) * sqrt({tp} + {fn}) "
               f"* sqrt({tn} + {fp}) * sqrt({tn} + {fn}), 0), 0)",
        "accuracy": ratio(f"{tp} + {tn}", f"{tp} + {fp} + {tn} + {fn}"),
        "false_positive_rate": ratio(fp, f"{fp} + {tn}"),
        "false_negative_rate": ratio(fn, f"{fn} + {tp}"),
        "specificity": ratio(tn, f"{tn} + {fp}"),
    }


METRIC_COLUMNS = ", ".join(f"{d6(e)} AS {m}" for m, e in metric_exprs().items())


def metric_row(df, keys=()):
    return df.select(*keys, "tp", "fp", "tn", "fn", *[r6(m).alias(m) for m in M.METRICS])


def long_metrics(src: str, names, keys="") -> str:
    ex = metric_exprs()
    k = keys + ", " if keys else ""
    return " UNION ALL ".join(f"SELECT {k}'{m}' AS metric, {ex[m]} AS value FROM {src}" for m in names)


def predictions(spark, sf):
    return scored(spark, sf).withColumn("predicted", F.col("dangerous"))


# -- §2.9 ----------------------------------------------------------------------
@query("classification_metrics", Q.with_(SCORED) + f"""
SELECT category, tp, fp, tn, fn, tp + fp + tn + fn AS n, {METRIC_COLUMNS}
FROM (SELECT category, {cells()} FROM scored GROUP BY category)""")
def classification_metrics(spark, sf):
    m = M.classification_metrics(predictions(spark, sf), ["category"])
    return m.select("category", "tp", "fp", "tn", "fn", "n", *[r6(c).alias(c) for c in M.METRICS])


CURVE = """, pts AS (SELECT risk, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY risk),
cum AS (SELECT risk, pos, neg, sum(pos) OVER (ORDER BY risk DESC) AS cp, sum(neg) OVER (ORDER BY risk DESC) AS cn,
  sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM pts)
"""


@query("roc_curve", Q.with_(SCORED) + CURVE + f"""
SELECT {d6('cn / an')} AS fpr, {d6('cp / ap')} AS tpr, {d6('risk')} AS threshold FROM cum
UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, 'inf'::DOUBLE""")
def roc_curve(spark, sf):
    return M.roc_curve(scored(spark, sf)).select(r6("fpr").alias("fpr"), r6("tpr").alias("tpr"),
                                                 F.when(F.col("threshold") < 2, r6("threshold")).otherwise(
                                                     F.col("threshold")).alias("threshold"))


@query("pr_curve", Q.with_(SCORED) + CURVE + f"""
SELECT {d6('cp / (cp + cn)')} AS precision, {d6('cp / ap')} AS recall, {d6('risk')} AS threshold FROM cum
UNION ALL SELECT 1.0::DOUBLE, 0.0::DOUBLE, NULL""")
def pr_curve(spark, sf):
    return M.pr_curve(scored(spark, sf)).select(
        *[r6(c).alias(c) for c in ("precision", "recall", "threshold")])


def areas_sql(key: str = "category", rows: str = "scored") -> str:
    """CTE ``areas``: both areas per ``key`` of rows with label and risk."""
    return f""", pts AS (SELECT {key}, risk, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM {rows} GROUP BY {key}, risk),
cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
  sum(pos) OVER (PARTITION BY {key}) AS ap, sum(neg) OVER (PARTITION BY {key}) AS an
  FROM pts WINDOW w AS (PARTITION BY {key} ORDER BY risk DESC)),
pt AS (SELECT *, cp / ap AS tpr, cn / an AS fpr, cp / (cp + cn) AS prec,
  lag(cp / ap, 1, 0.0) OVER w AS ptpr, lag(cn / an, 1, 0.0) OVER w AS pfpr, lag(cp / (cp + cn), 1, 1.0) OVER w AS pprec
  FROM cum WHERE ap > 0 AND an > 0 WINDOW w AS (PARTITION BY {key} ORDER BY risk DESC)),
areas AS (SELECT {key}, sum((fpr - pfpr) * (tpr + ptpr) / 2) AS roc, sum((tpr - ptpr) * (prec + pprec) / 2) AS pr
  FROM pt GROUP BY {key})
"""


AREAS = areas_sql()


@query("roc_auc", Q.with_(SCORED) + AREAS + f"""
SELECT c.category, {d6('a.roc')} AS roc_auc FROM (SELECT DISTINCT category FROM scored) c
LEFT JOIN areas a ON a.category = c.category""")
def roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf), ["category"]).select("category", r6("roc_auc").alias("roc_auc"))


@query("pr_auc", Q.with_(SCORED) + AREAS + f"""
SELECT c.category, {d6('a.pr')} AS pr_auc FROM (SELECT DISTINCT category FROM scored) c
LEFT JOIN areas a ON a.category = c.category""")
def pr_auc(spark, sf):
    return M.pr_auc(scored(spark, sf), ["category"]).select("category", r6("pr_auc").alias("pr_auc"))


def threshold_sql(metric: str) -> str:
    return Q.with_(SCORED) + f""", cand AS (SELECT DISTINCT {Q.half_even('risk', 3)} AS thr FROM scored UNION SELECT 0.5),
hist AS (SELECT risk, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY risk),
tried AS (SELECT thr, sum(pos) FILTER (risk >= thr) AS tp, sum(neg) FILTER (risk >= thr) AS fp,
  sum(pos) FILTER (risk < thr) AS fn, sum(neg) FILTER (risk < thr) AS tn FROM cand, hist GROUP BY thr),
cells AS (SELECT thr, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, coalesce(fn, 0) AS fn FROM tried),
m AS (SELECT thr, {metric} AS metric FROM cells)
SELECT {d6('thr')} AS threshold, {d6('metric')} AS metric FROM m ORDER BY m.metric DESC, thr LIMIT 1"""


@query("tune_threshold", threshold_sql(metric_exprs()["f1"]))
def tune_threshold(spark, sf):
    return M.tune_threshold(scored(spark, sf)).select(r6("threshold").alias("threshold"), r6("metric").alias("metric"))


@query("tune_threshold_min_fp", threshold_sql(
    f"CASE WHEN {metric_exprs()['false_positive_rate']} <= 0.05 THEN {metric_exprs()['recall']} ELSE -1 END"))
def tune_threshold_min_fp(spark, sf):
    return M.tune_threshold(scored(spark, sf), "min_fp").select(
        r6("threshold").alias("threshold"), r6("metric").alias("metric"))


@query("per_category_recall", Q.with_(SCORED) + f"""
SELECT category, count(*) AS n, count(*) FILTER (label = 1) AS n_dangerous, count(*) FILTER (label = 0) AS n_safe,
  {d6('avg(dangerous::INTEGER) FILTER (label = 1)')} AS recall_dangerous,
  {d6('avg(dangerous::INTEGER) FILTER (label = 0)')} AS false_positive_rate_safe FROM scored GROUP BY category""")
def per_category_recall(spark, sf):
    m = M.per_category_recall(predictions(spark, sf))
    return m.select("category", "n", "n_dangerous", "n_safe", r6("recall_dangerous").alias("recall_dangerous"),
                    r6("false_positive_rate_safe").alias("false_positive_rate_safe"))


@query("corpus_counts", Q.with_(Q.scripts()) + """
SELECT category, label_name, count(*) AS n FROM scripts GROUP BY GROUPING SETS ((category), (label_name), ())""")
def corpus_counts(spark, sf):
    return M.corpus_counts(corpus(spark, sf))


@query("top_risk", Q.with_(SCORED) + f"""
SELECT id, category, template, {d6('risk')} AS risk FROM scored WHERE label = 1 ORDER BY scored.risk DESC, id LIMIT 20""")
def top_risk(spark, sf):
    return M.top_risk(scored(spark, sf)).withColumn("risk", r6("risk"))


@query("fpr_reduction", Q.with_(SCORED) + f"""
, strict AS (SELECT category, {cells(p='risk >= 0.8')} FROM scored GROUP BY category),
wide AS (SELECT category, {cells(p='risk >= 0.25')} FROM scored GROUP BY category),
a AS (SELECT category, {metric_exprs()['false_positive_rate']} AS fpr FROM strict),
b AS (SELECT category, {metric_exprs()['false_positive_rate']} AS fpr FROM wide)
SELECT a.category, {d6('a.fpr')} AS fpr_a, {d6('b.fpr')} AS fpr_b, {d6('(b.fpr - a.fpr) / b.fpr * 100.0')} AS reduction_pct
FROM a JOIN b ON a.category = b.category WHERE b.fpr > 0""")
def fpr_reduction(spark, sf):
    """DENY-only flags against flags from MONITOR up, per category."""
    rows = scored(spark, sf)
    strict = M.classification_metrics(rows.withColumn("predicted", F.col("risk") >= 0.8), ["category"])
    wide = M.classification_metrics(rows.withColumn("predicted", F.col("risk") >= 0.25), ["category"])
    out = M.fpr_reduction(strict, wide, ["category"])
    return out.select("category", *[r6(c).alias(c) for c in ("fpr_a", "fpr_b", "reduction_pct")])


@query("latency_summary", f"""
WITH best AS (SELECT user_id, min(value) AS ms FROM events GROUP BY user_id),
r AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM best)
SELECT max(n) AS n, {d6('avg(ms)')} AS mean_ms, {d6('median(ms)')} AS median_ms,
  {d6('max(ms) FILTER (i = round_even(0.95 * (n - 1), 0))')} AS p95_ms,
  {d6('max(ms) FILTER (i = round_even(0.99 * (n - 1), 0))')} AS p99_ms,
  {d6('min(ms)')} AS min_ms, {d6('max(ms)')} AS max_ms, {d6('stddev_pop(ms)')} AS stdev_ms,
  {d6('1000 / avg(ms)')} AS throughput_per_sec FROM r""")
def latency_summary(spark, sf):
    out = M.latency_summary(table(spark, sf, "events"), "user_id", "value")
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


FINDINGS = f"""findings AS (
  SELECT id, ['error', 'warning', 'info', 'style'][{Q.hexnum("h", 1, 2)} % 4 + 1] AS level FROM (
    SELECT id, {Q.md5("'lint'", 'id', 'j')} AS h FROM (
      SELECT id, unnest(range({Q.hexnum(Q.md5("'lint'", 'id'), 1, 2)} % 4)) AS j FROM scripts)))"""


def findings(rows):
    """0 to 3 lint findings per script, drawn from its id."""
    n = F.pmod(hex_number(digest("lint", F.col("id")), 1, 2), F.lit(4))
    drawn = rows.filter(n > 0).select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("j"))
    pick = F.pmod(hex_number(digest("lint", F.col("id"), F.col("j")), 1, 2), F.lit(4)).cast("int") + 1
    return drawn.select("id", F.element_at(F.array(*[F.lit(x) for x in ("error", "warning", "info", "style")]), pick).alias("level"))


@query("findings_to_decision", Q.with_(Q.scripts(), FINDINGS) + """
SELECT s.category, count(*) AS n, count(*) FILTER (f.flag) AS flagged, count(*) FILTER (f.flag_error) AS flagged_error,
  round(avg(coalesce(f.k, 0)), 6) AS mean_findings
FROM scripts s LEFT JOIN (SELECT id, bool_or(level IN ('error', 'warning')) AS flag, bool_or(level = 'error') AS flag_error,
  count(*) AS k FROM findings GROUP BY id) f ON f.id = s.id GROUP BY s.category""")
def findings_to_decision(spark, sf):
    rows = corpus(spark, sf).select("id", "category")
    out = M.findings_to_decision(rows, findings(rows))
    return out.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("flagged"),
        F.count_if("flag_error").alias("flagged_error"), r6(F.avg("n_findings")).alias("mean_findings"))


# -- §2.10 ---------------------------------------------------------------------
def split_sql(src: str, name: str = "sp", frac: float = 0.4) -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY h, id) AS rk,
  count(*) OVER (PARTITION BY category, label) AS sz FROM (SELECT *, {Q.md5("'1337'", 'id')} AS h FROM {src})),
{name} AS (SELECT * EXCLUDE (rk, sz, h), CASE WHEN sz > 1 AND rk <= greatest(1, round_even(sz * {frac}, 0)) THEN 'test' ELSE 'train' END AS split
  FROM {name}_r)"""


@query("stratified_split", Q.with_(Q.scripts(), split_sql("scripts")) + "SELECT id, category, label, split FROM sp")
def stratified_split(spark, sf):
    return splits.stratified_split(corpus(spark, sf).select("id", "category", "label")).select(
        "id", "category", "label", "split")


@query("split_summary", Q.with_(Q.scripts(), split_sql("scripts")) + """
SELECT split, category, count(*) AS n, count(*) FILTER (label = 0) AS n_safe, count(*) FILTER (label = 1) AS n_dangerous
FROM sp GROUP BY GROUPING SETS ((split, category), (split))""")
def split_summary(spark, sf):
    return M.split_summary(splits.stratified_split(corpus(spark, sf).select("id", "category", "label")))


LABELLED = """(SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source, l.toxic AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def labelled_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), "source", F.col("toxic").alias("label"))


@query("stratified_folds", f"""
SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY {Q.md5("'1337'", 'id')}, id) - 1) % 5)::INTEGER AS fold
FROM {LABELLED}""")
def stratified_folds(spark, sf):
    return splits.stratified_folds(labelled_documents(spark, sf)).select("id", "label", "fold")


def grouped_sql(src: str, group: str, name: str = "gf", k: int = 5) -> str:
    return f"""{name} AS (SELECT grp, (CASE WHEN t < {k} THEN t ELSE {2 * k - 1} - t END)::INTEGER AS fold FROM (
  SELECT grp, (row_number() OVER (PARTITION BY major ORDER BY sz DESC, h, grp) - 1) % {2 * k} AS t FROM (
    SELECT {group} AS grp, count(*) AS sz, CASE WHEN sum(label) * 2 > count(*) THEN 1 ELSE 0 END AS major,
      {Q.md5("'1337'", group)} AS h FROM {src} GROUP BY {group})))"""


@query("grouped_folds", f"WITH ld AS {LABELLED}, " + grouped_sql("ld", "source") + """
SELECT id, source, fold FROM ld JOIN gf ON gf.grp = ld.source""")
def grouped_folds(spark, sf):
    return splits.grouped_folds(labelled_documents(spark, sf), group="source").select("id", "source", "fold")


FOLDED = Q.with_(SCORED, grouped_sql("scripts", "template")) + f""", rows AS (
  SELECT s.*, gf.fold FROM scored s JOIN gf ON gf.grp = s.template),
pf AS (SELECT fold, {cells()} FROM rows GROUP BY fold)"""


def folded(spark, sf):
    return splits.grouped_folds(predictions(spark, sf).select("id", "template", "label", "risk", "predicted"))


@query("cv_summary", FOLDED + ", long AS (" + " UNION ALL ".join(
    f"SELECT fold, '{m}' AS metric, {e} AS value FROM pf" for m, e in metric_exprs().items()) + f""")
SELECT metric, {d6('avg(value)')} AS mean, {d6('stddev_pop(value)')} AS std, {d6('min(value)')} AS min,
  {d6('max(value)')} AS max, string_agg(printf('%.4f', round(value, 4)), ',' ORDER BY fold) AS values FROM long GROUP BY metric""")
def cv_summary(spark, sf):
    """Default model over leave-template-out folds."""
    per_fold = M.classification_metrics(folded(spark, sf), ["fold"])
    out = splits.cv_summary(per_fold, M.METRICS)
    text = F.array_join(F.transform("values", lambda v: F.format_string("%.4f", F.round(v, 4))), ",")
    return out.select("metric", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")], text.alias("values"))


@query("pooled_oof", FOLDED + f""", oof AS (SELECT label, CASE WHEN fold % 2 = 0 THEN risk >= 0.5 ELSE risk >= 0.6 END AS p FROM rows),
c AS (SELECT {cells(p='p')} FROM oof) SELECT tp, fp, tn, fn, {METRIC_COLUMNS} FROM c""")
def pooled_oof(spark, sf):
    """One metric row over out-of-fold decisions (per-fold thresholds)."""
    rows = folded(spark, sf)
    thr = F.when(F.col("fold") % 2 == 0, 0.5).otherwise(0.6)
    return metric_row(M.classification_metrics(rows.withColumn("predicted", F.col("risk") >= thr)))


# -- §2.11 ---------------------------------------------------------------------
def ln_fact(x: str) -> str:
    return (f"(CASE WHEN {x} <= 20 THEN ln(factorial(least({x}, 20)::INTEGER)::DOUBLE) ELSE {x}::DOUBLE * ln({x}::DOUBLE) - {x} "
            f"+ 0.5 * ln(2 * pi() * {x}) + 1 / (12.0::DOUBLE * {x}) - 1 / (360.0::DOUBLE * power({x}::DOUBLE, 3)) "
            f"+ 1 / (1260.0::DOUBLE * power({x}::DOUBLE, 5)) END)")


def binomial_cdf_sql(params: str, keys: str, name: str) -> str:
    """CTEs up to ``name``_cdf: keys, k and the cumulative probability v."""
    pmf = (f"CASE WHEN p <= 0 THEN (k = 0)::INTEGER::DOUBLE WHEN p >= 1 THEN (k = n)::INTEGER::DOUBLE ELSE exp({ln_fact('n')} - {ln_fact('k')} - {ln_fact('(n - k)')} "
           f"+ CASE WHEN k = 0 THEN 0 ELSE k * ln(p) END + CASE WHEN n = k THEN 0 ELSE (n - k) * ln(1 - p) END) END")
    # 13.4 + sqrt(178 + 80 var): Bernstein's bound at exp(-40), rounded up
    reach = "(13.4 + sqrt(178 + 80 * n * p * (1 - p)))"
    return f"""{name}_k AS (SELECT {keys}, n, p, unnest(range(
    greatest(0, floor(n * p - {reach}) - 2)::BIGINT,
    least(n, (ceil(n * p + {reach}) + 2)::BIGINT) + 1)) AS k FROM {params}),
{name}_cdf AS (SELECT {keys}, k, sum({pmf}) OVER (PARTITION BY {keys} ORDER BY k) AS v FROM {name}_k)"""


def binomial_sql(params: str, points: str, keys: str, name: str) -> str:
    """CTE ``name``: inverse-cumulative binomial draws (keys, b, draw)."""
    on = " AND ".join(f"t.{k.strip()} = u.{k.strip()}" for k in keys.split(","))
    return f"""{binomial_cdf_sql(params, keys, name)},
{name} AS (SELECT {', '.join('u.' + k.strip() for k in keys.split(','))}, u.b, t.k AS draw
  FROM {points} u ASOF JOIN {name}_cdf t ON {on} AND t.v >= u.u)"""


BOOT = Q.with_(SCORED) + f""", cell AS (SELECT {cells()} FROM scored),
params AS (SELECT 'pos' AS cls, tp + fn AS n, tp / (tp + fn)::DOUBLE AS p FROM cell
  UNION ALL SELECT 'neg', fp + tn, fp / (fp + tn)::DOUBLE FROM cell),
points AS (SELECT cls, b, {Q.uniform(Q.md5("'1337'", 'b', 'cls'))} AS u FROM (SELECT unnest(range(2000)) AS b), (SELECT unnest(['pos', 'neg']) AS cls)),
{binomial_sql('params', 'points', 'cls', 'drawn')},
reps AS (SELECT b, x.tp, n_pos - x.tp AS fn, x.fp, n_neg - x.fp AS tn FROM (
  SELECT b, max(draw) FILTER (cls = 'pos') AS tp, max(draw) FILTER (cls = 'neg') AS fp FROM drawn GROUP BY b) x,
  (SELECT tp + fn AS n_pos, fp + tn AS n_neg FROM cell))"""


def interval_sql(reps: str, point: str, names) -> str:
    return f"""SELECT v.metric, {d6('any_value(pt.value)')} AS point, {d6('quantile_cont(v.value, 0.025)')} AS ci_low,
  {d6('quantile_cont(v.value, 0.975)')} AS ci_high, count(*) AS n_boot
FROM ({long_metrics(reps, names)}) v JOIN ({long_metrics(point, names)}) pt ON pt.metric = v.metric GROUP BY v.metric"""


@query("bootstrap_ci", BOOT + interval_sql("reps", "cell", stats.BOOT_METRICS))
def bootstrap_ci(spark, sf):
    out = stats.bootstrap_ci(predictions(spark, sf))
    return out.select("metric", *[r6(c).alias(c) for c in ("point", "ci_low", "ci_high")], "n_boot")


# Levels of the score tree of the check: up to 4,096 distinct scores.
AREA_LEVELS = 12


def area_level_sql(h: int) -> str:
    """CTEs from the nodes ``ar{h}`` of height h to their halves ``ar{h - 1}``."""
    u = Q.uniform(Q.md5("'1337'", "'area'", "cls", str(h), "node", "b"))
    sides = " UNION ALL ".join(
        f"SELECT '{c}' AS cls, r.node, r.{c} AS m, r.b, p.p_{c} AS p FROM ar{h} r JOIN asplit p ON p.height = {h} AND p.node = r.node WHERE r.{c} > 0 AND p.p_{c} > 0 AND p.p_{c} < 1"
        for c in ("pos", "neg"))
    return f"""as{h} AS MATERIALIZED ({sides}),
ap{h} AS MATERIALIZED (SELECT DISTINCT cls, node, m, m AS n, p FROM as{h}),
au{h} AS MATERIALIZED (SELECT cls, node, m, b, {u} AS u FROM as{h}),
{binomial_cdf_sql(f'ap{h}', 'cls, node, m', f'ad{h}')},
ad{h} AS MATERIALIZED (SELECT * FROM (SELECT cls, node, m, b, min(k) OVER (PARTITION BY cls, node, m ORDER BY v, b IS NULL
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS draw
  FROM (SELECT cls, node, m, b, u AS v, NULL::BIGINT AS k FROM au{h} UNION ALL SELECT cls, node, m, NULL, v, k FROM ad{h}_cdf)) WHERE b IS NOT NULL),
al{h} AS MATERIALIZED (SELECT r.*, CASE WHEN p_pos >= 1 THEN r.pos ELSE coalesce(x.draw, 0) END AS lp,
  CASE WHEN p_neg >= 1 THEN r.neg ELSE coalesce(y.draw, 0) END AS ln FROM ar{h} r JOIN asplit p ON p.height = {h} AND p.node = r.node
  LEFT JOIN ad{h} x ON x.cls = 'pos' AND x.node = r.node AND x.b = r.b LEFT JOIN ad{h} y ON y.cls = 'neg' AND y.node = r.node AND y.b = r.b),
ar{h - 1} AS MATERIALIZED (SELECT * FROM (
  SELECT b, node * 2 + 1 AS node, pos - lp AS pos, neg - ln AS neg, ap, an FROM al{h}
  UNION ALL SELECT b, node * 2, lp, ln, ap + pos - lp, an + neg - ln FROM al{h}) WHERE pos + neg > 0)"""


AREA = Q.with_(SCORED) + f""", ac AS MATERIALIZED (SELECT row_number() OVER (ORDER BY risk) - 1 AS rank, count(*) FILTER (label = 1) AS pos,
  count(*) FILTER (label = 0) AS neg FROM scored GROUP BY risk),
an AS (SELECT h AS height, rank >> h AS node, sum(pos)::DOUBLE AS pos, sum(neg)::DOUBLE AS neg,
  coalesce(sum(pos) FILTER ((rank >> (h - 1)) % 2 = 0), 0) AS lp, coalesce(sum(neg) FILTER ((rank >> (h - 1)) % 2 = 0), 0) AS ln
  FROM ac, (SELECT unnest(range(1, {AREA_LEVELS + 1}))::INTEGER AS h) GROUP BY ALL),
asplit AS MATERIALIZED (SELECT height, node, CASE WHEN pos > 0 THEN lp / pos ELSE 0 END AS p_pos, CASE WHEN neg > 0 THEN ln / neg ELSE 0 END AS p_neg FROM an),
ar{AREA_LEVELS} AS MATERIALIZED (SELECT b, 0::BIGINT AS node, p::BIGINT AS pos, n::BIGINT AS neg, 0::BIGINT AS ap, 0::BIGINT AS an
  FROM (SELECT unnest(range(2000)) AS b), (SELECT sum(pos) AS p, sum(neg) AS n FROM ac)),
{(',' + chr(10)).join(area_level_sql(h) for h in range(AREA_LEVELS, 0, -1))},
areps AS (SELECT b, sum(neg * (ap::DOUBLE + pos / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) AS roc_auc,
  sum(pos * ((ap + pos) / (ap + an + pos + neg)::DOUBLE + CASE WHEN ap + an > 0 THEN ap / (ap + an)::DOUBLE ELSE 1 END) / 2.0) / sum(pos) AS pr_auc
  FROM ar0 GROUP BY b),
arun AS (SELECT pos, neg, coalesce(sum(pos) OVER w, 0) AS ap, coalesce(sum(neg) OVER w, 0) AS an FROM ac
  WINDOW w AS (ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
apoint AS (SELECT sum(neg * (ap::DOUBLE + pos / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) AS roc_auc,
  sum(pos * ((ap + pos) / (ap + an + pos + neg)::DOUBLE + CASE WHEN ap + an > 0 THEN ap / (ap + an)::DOUBLE ELSE 1 END) / 2.0) / sum(pos) AS pr_auc FROM arun),
along AS (SELECT 'roc_auc' AS metric, roc_auc AS value FROM areps UNION ALL SELECT 'pr_auc', pr_auc FROM areps),
aplong AS (SELECT 'roc_auc' AS metric, roc_auc AS value FROM apoint UNION ALL SELECT 'pr_auc', pr_auc FROM apoint)
SELECT v.metric, {d6('any_value(pt.value)')} AS point, {d6('quantile_cont(v.value, 0.025)')} AS ci_low,
  {d6('quantile_cont(v.value, 0.975)')} AS ci_high, count(*) AS n_boot
FROM along v JOIN aplong pt ON pt.metric = v.metric GROUP BY v.metric"""


@query("bootstrap_auc_ci", AREA)
def bootstrap_auc_ci(spark, sf):
    out = stats.bootstrap_auc_ci(scored(spark, sf))
    return out.select("metric", *[r6(c).alias(c) for c in ("point", "ci_low", "ci_high")], "n_boot")


CLUSTER = f"""cell AS (SELECT {cells()} FROM scored),
cc AS (SELECT template, {cells()} FROM scored GROUP BY template),
num AS (SELECT *, row_number() OVER (ORDER BY {Q.md5("'1337'", 'template')}, template) AS pos, count(*) OVER () AS size FROM cc),
cdraw AS (SELECT b, {Q.hexnum(Q.md5("'1337'", "'cluster'", 'b', 'j'), 1, 12)} % size + 1 AS pos
  FROM (SELECT pos - 1 AS j, size FROM num), (SELECT unnest(range(2000)) AS b)),
creps AS (SELECT b, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM cdraw JOIN num USING (pos) GROUP BY b
  HAVING sum(tp) + sum(fn) > 0 AND sum(fp) + sum(tn) > 0)"""


@query("cluster_bootstrap_ci", Q.with_(SCORED, CLUSTER) + interval_sql("creps", "cell", stats.CLUSTER_METRICS))
def cluster_bootstrap_ci(spark, sf):
    out = stats.cluster_bootstrap_ci(predictions(spark, sf))
    return out.select("metric", *[r6(c).alias(c) for c in ("point", "ci_low", "ci_high")], "n_boot")


NAIVE = f"""tot AS (SELECT tp + fp + tn + fn AS n_all, tp + fn AS n_pos, tp / (tp + fn)::DOUBLE AS p_tp, fp / (fp + tn)::DOUBLE AS p_fp FROM cell),
bs AS (SELECT unnest(range(2000)) AS b),
par1 AS (SELECT 0 AS g, n_all AS n, n_pos / n_all::DOUBLE AS p FROM tot),
pt1 AS (SELECT 0 AS g, b, {Q.uniform(Q.md5("'1337'", "'positives'", 'b'))} AS u FROM bs),
{binomial_sql('par1', 'pt1', 'g', 'posd')},
par2 AS (SELECT 'tp' AS cell, b AS rep, draw AS n, p_tp AS p FROM posd, tot UNION ALL SELECT 'fp', b, n_all - draw, p_fp FROM posd, tot),
pt2 AS (SELECT 'tp' AS cell, b AS rep, b, {Q.uniform(Q.md5("'1337'", "'tp'", 'b'))} AS u FROM bs
  UNION ALL SELECT 'fp', b, b, {Q.uniform(Q.md5("'1337'", "'fp'", 'b'))} FROM bs),
{binomial_sql('par2', 'pt2', 'cell, rep', 'celld')},
nreps AS (SELECT x.b, x.tp, posd.draw - x.tp AS fn, x.fp, n_all - posd.draw - x.fp AS tn FROM (
  SELECT b, max(draw) FILTER (cell = 'tp') AS tp, max(draw) FILTER (cell = 'fp') AS fp FROM celld GROUP BY b) x
  JOIN posd ON posd.b = x.b, tot)"""


@query("naive_vs_cluster", Q.with_(SCORED, CLUSTER, NAIVE) + f"""
, c AS (SELECT metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM ({long_metrics('creps', stats.CLUSTER_METRICS)}) GROUP BY metric),
n AS (SELECT metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM ({long_metrics('nreps', stats.CLUSTER_METRICS)}) GROUP BY metric),
pt AS ({long_metrics('cell', stats.CLUSTER_METRICS)})
SELECT metric, {d6('pt.value')} AS point, {d6('c.lo')} AS cluster_low, {d6('c.hi')} AS cluster_high, {d6('n.lo')} AS naive_low,
  {d6('n.hi')} AS naive_high, round((c.hi - c.lo) / (n.hi - n.lo), 2) AS width_ratio
FROM c JOIN n USING (metric) JOIN pt USING (metric)""")
def naive_vs_cluster(spark, sf):
    out = stats.naive_vs_cluster(predictions(spark, sf))
    names = ["point", "cluster_low", "cluster_high", "naive_low", "naive_high"]
    return out.select("metric", *[r6(c).alias(c) for c in names], "width_ratio")


def wilson_sql(k: str, n: str) -> dict:
    z2 = "(1.96 * 1.96)::DOUBLE"
    p = f"({k}::DOUBLE / {n})"
    den = f"(1 + {z2} / {n})"
    center = f"(({p} + {z2} / (2 * {n})) / {den})"
    half = f"(1.96 * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n})) / {den})"
    return {"wilson_point": f"CASE WHEN {n} = 0 THEN 0 ELSE {p} END",
            "wilson_low": f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(0, {center} - {half}) END",
            "wilson_high": f"CASE WHEN {n} = 0 THEN 1 ELSE least(1, {center} + {half}) END"}


@query("wilson_interval", Q.with_(SCORED) + f"""
, k AS (SELECT template, count(*) FILTER (label = 0) AS n, count(*) FILTER (label = 0 AND dangerous) AS k FROM scored GROUP BY template)
SELECT template, n, k, {', '.join(f'{d6(e)} AS {c}' for c, e in wilson_sql('k', 'n').items())} FROM k""")
def wilson_interval(spark, sf):
    k = scored(spark, sf).groupBy("template").agg(
        F.count_if(F.col("label") == 0).alias("n"),
        F.count_if((F.col("label") == 0) & F.col("dangerous")).alias("k"))
    return stats.wilson_interval(k, "k", "n").select(
        "template", "n", "k", *[r6(c).alias(c) for c in ("wilson_point", "wilson_low", "wilson_high")])


def binomial_p(k: str, n: str) -> str:
    """Two-sided exact p-value: log-space terms of the lower tail."""
    term = f"exp({ln_fact('n')} - {ln_fact('i')} - {ln_fact('(n - i)')} - n * ln(2.0::DOUBLE))"
    return (f"CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT sum({term}) FROM "
            f"(SELECT {n} AS n, unnest(range({k} + 1)) AS i))) END")


PAIRED = """count(*) FILTER (ca AND NOT cb) AS b, count(*) FILTER (cb AND NOT ca) AS c,
  count(*) FILTER (ca AND cb) AS cc, count(*) FILTER (NOT ca AND NOT cb) AS ww"""


def mcnemar_columns(p: str) -> str:
    return f"""b AS a_correct_b_wrong, c AS b_correct_a_wrong, cc AS both_correct, ww AS both_wrong, b + c AS n_discordant,
  round({p}, 9) AS p_value, {p} < 0.05 AS significant, CASE WHEN b > c THEN 'A' WHEN c > b THEN 'B' ELSE 'tie' END AS better"""


def mcnemar_row(df, keys=()):
    return df.select(*keys, "a_correct_b_wrong", "b_correct_a_wrong", "both_correct", "both_wrong", "n_discordant",
                     F.round("p_value", 9).alias("p_value"), "significant", "better")


@query("mcnemar", Q.with_(SCORED, FINDINGS) + f"""
, lint AS (SELECT id, bool_or(level IN ('error', 'warning')) AS flag FROM findings GROUP BY id),
pr AS (SELECT (s.dangerous::INTEGER = label) AS ca, (coalesce(l.flag, false)::INTEGER = label) AS cb
  FROM scored s LEFT JOIN lint l ON l.id = s.id),
k AS (SELECT {PAIRED} FROM pr),
p AS (SELECT *, {binomial_p('least(b, c)', '(b + c)')} AS pv FROM k) SELECT {mcnemar_columns('pv')} FROM p""")
def mcnemar(spark, sf):
    """The risk model against the lint findings of the same scripts."""
    ours = predictions(spark, sf).select("id", "label", "predicted")
    ids = corpus(spark, sf).select("id")
    lint = M.findings_to_decision(ids, findings(ids)).select("id", F.col("flag").alias("predicted"))
    return mcnemar_row(stats.mcnemar(ours, lint))


BINS = f""", edges AS (SELECT i::INTEGER AS bin, (i * 0.1::DOUBLE) AS lo, CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi
  FROM (SELECT unnest(range(10)) AS i)),
bins AS (SELECT e.bin, e.lo, e.hi, count(s.id) AS n, avg(s.risk) AS confidence, avg(s.label) AS accuracy FROM edges e
  LEFT JOIN scored s ON s.risk <= e.hi AND (s.risk > e.lo OR (e.bin = 0 AND s.risk >= e.lo)) GROUP BY ALL)"""


@query("reliability_bins", Q.with_(SCORED) + BINS + f"""
SELECT bin, {d6('lo')} AS lo, {d6('hi')} AS hi, n, {d6('confidence')} AS confidence, {d6('accuracy')} AS accuracy FROM bins""")
def reliability_bins(spark, sf):
    out = stats.reliability_bins(scored(spark, sf))
    return out.select("bin", "n", *[r6(c).alias(c) for c in ("lo", "hi", "confidence", "accuracy")])


@query("expected_calibration_error", Q.with_(SCORED) + BINS + f"""
SELECT {d6('sum(n * abs(accuracy - confidence)) / sum(n)')} AS ece FROM bins""")
def expected_calibration_error(spark, sf):
    return stats.expected_calibration_error(scored(spark, sf)).select(r6("ece").alias("ece"))


@query("brier_score", Q.with_(SCORED) + f"SELECT category, {d6('avg(power(risk - label, 2))')} AS brier FROM scored GROUP BY category")
def brier_score(spark, sf):
    return stats.brier_score(scored(spark, sf), keys=["category"]).select("category", r6("brier").alias("brier"))


def calibrated(spark, sf, fit):
    rows = splits.stratified_split(scored(spark, sf))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    return fit(train, test)


def _calibration_row(df, out):
    return stats.expected_calibration_error(df, prob=out).withColumn("method", F.lit(out)).join(
        stats.brier_score(df, prob=out).withColumn("method", F.lit(out)), "method").select(
        "method", r6("ece").alias("ece"), r6("brier").alias("brier"))


CALIBRATED = Q.with_(SCORED, split_sql("scored")) + """, tr AS MATERIALIZED (
  SELECT risk AS x, count(*)::DOUBLE AS w, sum(label)::DOUBLE AS wy FROM sp WHERE split = 'train' GROUP BY risk),
te AS MATERIALIZED (SELECT label, risk AS x FROM sp WHERE split = 'test')"""


def calibration_row_sql(name: str, src: str) -> str:
    """The error of ``src`` (label, p) as the query reports it."""
    return f"""SELECT '{name}' AS method, (SELECT {d6('sum(n * abs(acc - conf)) / sum(n)')} FROM (
    SELECT count(*) AS n, avg(label) AS acc, avg(p) AS conf FROM {src} GROUP BY least(9, greatest(0, ceil(p * 10) - 1)))) AS ece,
  (SELECT {d6('avg(power(p - label, 2))')} FROM {src}) AS brier"""


# The greatest of the smallest means: of all runs of scores around a score, over their
# left ends the largest of the means that are smallest over their right ends.
ISOTONIC = CALIBRATED + f""", cu AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(wy) OVER (ORDER BY x) AS cy, w, wy FROM tr),
runs AS (SELECT j.i AS j, k.i AS k, (k.cy - j.cy + j.wy) / (k.cw - j.cw + j.w) AS m FROM cu j JOIN cu k ON k.i >= j.i),
least_mean AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS m FROM runs),
iso AS MATERIALIZED (SELECT cu.x, max(m) AS f FROM least_mean JOIN cu ON cu.i = k GROUP BY cu.x),
near AS (SELECT te.label, te.x, l.x AS lx, l.f AS lf, h.x AS hx, h.f AS hf FROM te
  ASOF LEFT JOIN iso l ON te.x >= l.x ASOF LEFT JOIN iso h ON te.x <= h.x),
cal AS (SELECT label, CASE WHEN lx IS NULL THEN hf WHEN hx IS NULL OR lx = x THEN lf ELSE lf + (hf - lf) * (x - lx) / (hx - lx) END AS p FROM near)
{calibration_row_sql('isotonic', 'cal')}"""

# Newton steps on slope and intercept, far more than they need to settle.
PLATT = CALIBRATED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", nt(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT i, a, b, sum((w * p - wy) * x) + a AS ga, sum(w * p - wy) AS gb, sum(w * p * (1 - p) * x * x) + 1 AS haa,
      sum(w * p * (1 - p) * x) AS hab, sum(w * p * (1 - p)) AS hbb
    FROM (SELECT *, {Q.sigmoid('a * x + b')} AS p FROM nt, tr WHERE i < 40) GROUP BY i, a, b)),
cal AS (SELECT label, {Q.sigmoid('a * x + b')} AS p FROM te, (SELECT a, b FROM nt WHERE i = 40))
{calibration_row_sql('platt', 'cal')}"""


@query("isotonic_calibrate", ISOTONIC)
def isotonic_calibrate(spark, sf):
    return _calibration_row(calibrated(spark, sf, stats.isotonic_calibrate), "isotonic")


@query("platt_calibrate", PLATT)
def platt_calibrate(spark, sf):
    return _calibration_row(calibrated(spark, sf, stats.platt_calibrate), "platt")


# -- agreement: the two label columns of the documents, and the corpus labels -------
DOC_AB = """a AS (SELECT doc_id AS id, quality AS label FROM labels), b AS (SELECT doc_id AS id, 1 - toxic AS label FROM labels)"""
SCRIPT_AB = f"""a AS (SELECT id, label FROM scripts WHERE {Q.hexnum(Q.md5("'a'", 'id'), 1, 2)} >= 3),
b AS (SELECT id, (CASE WHEN {Q.hexnum(Q.md5("'b'", 'id'), 3, 2)} < 26 THEN 1 - label ELSE label END)::INTEGER AS label
  FROM scripts WHERE {Q.hexnum(Q.md5("'b'", 'id'), 1, 2)} >= 5)"""
KAPPA = """, pr AS (SELECT a.label AS la, b.label AS lb FROM a JOIN b ON a.id = b.id),
po AS (SELECT count(*) AS n, count(*) FILTER (la = lb) / count(*)::DOUBLE AS po FROM pr),
pe AS (SELECT sum(x.k * y.k)::DOUBLE / (any_value(n)::DOUBLE * any_value(n)) AS pe FROM (SELECT la, count(*) AS k FROM pr GROUP BY la) x
  JOIN (SELECT lb, count(*) AS k FROM pr GROUP BY lb) y ON x.la = y.lb, po),
kap AS (SELECT n, po, pe, CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END AS kappa FROM po, pe)"""


def doc_labels(spark, sf):
    rows = table(spark, sf, "labels")
    return (rows.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")),
            rows.select(F.col("doc_id").alias("id"), (1 - F.col("toxic")).alias("label")))


def script_labels(spark, sf):
    """Two raters of the corpus: the second errs on a tenth; each misses a few ids."""
    rows = corpus(spark, sf).select("id", "label")
    a = rows.filter(hex_number(digest("a", F.col("id")), 1, 2) >= 3)
    wrong = hex_number(digest("b", F.col("id")), 3, 2) < 26
    b = rows.filter(hex_number(digest("b", F.col("id")), 1, 2) >= 5).withColumn(
        "label", F.when(wrong, 1 - F.col("label")).otherwise(F.col("label")))
    return a, b


@query("cohen_kappa", f"WITH {DOC_AB}{KAPPA} SELECT n, {d6('po')} AS observed, {d6('pe')} AS expected, {d6('kappa')} AS kappa FROM kap")
def cohen_kappa(spark, sf):
    return agreement.cohen_kappa(*doc_labels(spark, sf)).select(
        "n", *[r6(c).alias(c) for c in ("observed", "expected", "kappa")])


@query("agreement_confusion", f"""WITH {DOC_AB} SELECT a.label AS label_a, b.label AS label_b, count(*) AS n
FROM a JOIN b ON a.id = b.id GROUP BY ALL""")
def agreement_confusion(spark, sf):
    return agreement.agreement_confusion(*doc_labels(spark, sf))


def band_case(k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} < {b!r} THEN '{t}'" for b, t in K.KAPPA_BANDS) + f" ELSE '{K.KAPPA_TOP_BAND}' END"


@query("agreement_report", Q.with_(Q.scripts(), SCRIPT_AB) + KAPPA + f""",
fo AS (SELECT a.label AS la, b.label AS lb FROM a FULL JOIN b ON a.id = b.id)
SELECT count(*) FILTER (la IS NOT NULL AND lb IS NOT NULL) AS n_scored, round(any_value(po), 4) AS raw_agreement,
  round(any_value(kappa), 4) AS cohen_kappa, {band_case('any_value(kappa)')} AS band, count(*) FILTER (la <> lb) AS n_disagreements,
  count(*) FILTER (lb IS NULL) AS n_only_a, count(*) FILTER (la IS NULL) AS n_only_b FROM fo, kap""")
def agreement_report(spark, sf):
    return agreement.agreement_report(*script_labels(spark, sf))


@query("agreement_rows", Q.with_(Q.scripts(), SCRIPT_AB) + """
SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, a.label AS label_a, b.label AS label_b,
  CASE WHEN b.label IS NULL THEN 'only_a' WHEN a.label IS NULL THEN 'only_b' WHEN a.label <> b.label THEN 'disagreement' END AS kind
FROM a FULL JOIN b ON a.id = b.id) WHERE kind IS NOT NULL""")
def agreement_rows(spark, sf):
    return agreement.agreement_rows(*script_labels(spark, sf))


@query("kappa_band", Q.with_(SCORED) + f"""
, t AS (SELECT template, avg((dangerous::INTEGER = label)::INTEGER) * 2 - 1 AS k FROM scored GROUP BY template)
SELECT template, {d6('k')} AS value, {band_case('round(k, 6)')} AS band FROM t""")
def kappa_band(spark, sf):
    right = (F.col("dangerous").cast("int") == F.col("label")).cast("int")
    rows = scored(spark, sf).groupBy("template").agg(r6(F.avg(right) * 2 - 1).alias("value"))
    return rows.withColumn("band", agreement.kappa_band(F.col("value")))


# -- §2.7: syscalls observed in the event table -------------------------------------
# event type and k // 25 pick a syscall; k % 4 picks the level it runs under.
EVENT_SYSCALLS = {
    "click": ["read", "openat", "connect", "execve"], "view": ["stat", "mmap", "socket", "bind"],
    "signup": ["clone", "setuid", "sendto", "fork"], "purchase": ["write", "fcntl", "recvfrom", "ptrace"],
    "error": ["exit", "vfork", "dup2", "execveat"],
}
_K = "json_extract(props, '$.k')::INTEGER"
EVENTS_SQL = f"""ev AS (SELECT event_id, ts, {Q.text_list(K.LEVELS)}[k % 4 + 1] AS level, CASE event_type {' '.join(
    f"WHEN '{t}' THEN {Q.text_list(v)}[k // 25 + 1]" for t, v in EVENT_SYSCALLS.items())} END AS syscall
  FROM (SELECT *, {_K} AS k FROM events))"""
RULES_SQL = f"""base AS (SELECT unnest({Q.text_list(K.BASE_SYSCALLS)}) AS s), levels AS (SELECT unnest({Q.text_list(K.LEVELS)}) AS level),
rules AS (SELECT level, s AS syscall, 'allow' AS action FROM levels, base
  UNION {' UNION '.join(f"SELECT '{lv}', unnest({Q.text_list(v)}), 'allow'" for lv, v in K.LEVEL_SYSCALLS.items() if v)}
  UNION SELECT level, unnest({Q.text_list(K.NETWORK_DENIED_SYSCALLS)}), 'block' FROM levels WHERE level IN ('RESTRICT', 'DENY')
  UNION SELECT 'DENY', unnest({Q.text_list(K.KILLED_SYSCALLS)}), 'kill'),
dflt(level, decision) AS (VALUES {', '.join(f"('{lv}', '{K.LEVEL_POSTURE[lv][0]}')" for lv in K.LEVELS)}),
best AS (SELECT level, syscall, max(CASE action WHEN 'kill' THEN 3 WHEN 'block' THEN 2 ELSE 1 END) AS r FROM rules GROUP BY ALL),
decided AS (SELECT ev.event_id, ev.ts, ev.level, ev.syscall, d.decision,
  CASE WHEN r = 3 THEN 'kill' WHEN r = 2 THEN 'block' WHEN r = 1 THEN CASE WHEN d.decision IN ('allow_with_audit', 'sandbox') THEN 'audit' ELSE 'allow' END
       WHEN ev.level = 'TRUSTED' THEN 'default_allow' ELSE 'default_block' END AS kind
  FROM ev LEFT JOIN best ON best.level = ev.level AND best.syscall = ev.syscall JOIN dflt d ON d.level = ev.level)"""
DECIDED_COLUMNS = "replace(kind, 'default_', '') AS action, CASE kind " + " ".join(
    f"WHEN '{k}' THEN {Q.lit(v)}" for k, v in K.REASONS.items()) + " END AS reason"


def syscalls(events):
    """Level and syscall of each event row; works on a stream too."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.lit(None).cast("string")
    for kind, values in EVENT_SYSCALLS.items():
        name = F.when(F.col("event_type") == kind, F.element_at(
            F.array(*[F.lit(v) for v in values]), (F.floor(k / 25) + 1).cast("int"))).otherwise(name)
    level = F.element_at(F.array(*[F.lit(v) for v in K.LEVELS]), k % 4 + 1)
    return events.withColumns({"level": level, "syscall": name})


@query("policy_rules", "WITH " + EVENTS_SQL + ", " + RULES_SQL + """
SELECT rules.level, rules.syscall, action, count(ev.event_id) AS n_events FROM rules
LEFT JOIN ev ON ev.level = rules.level AND ev.syscall = rules.syscall GROUP BY ALL""")
def policy_rules(spark, sf):
    """Every rule with the number of events it matches."""
    rules = monitor.policy_rules(policy.policy_table(spark))
    seen = syscalls(table(spark, sf, "events")).groupBy("level", "syscall").agg(F.count(F.lit(1)).alias("n_events"))
    return rules.join(seen, ["level", "syscall"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


@query("decide_events", "WITH " + EVENTS_SQL + ", " + RULES_SQL + f"""
SELECT event_id, level, syscall, decision, {DECIDED_COLUMNS} FROM decided""")
def decide_events(spark, sf):
    decided = monitor.decide_events(syscalls(table(spark, sf, "events")), policy.policy_table(spark))
    return decided.select("event_id", "level", "syscall", "decision", "action", "reason")


@query("monitor_report", "WITH " + EVENTS_SQL + ", " + RULES_SQL + f"""
SELECT level, decision, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'audit') AS audited,
  count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'kill') AS killed
FROM (SELECT level, decision, {DECIDED_COLUMNS} FROM decided) GROUP BY ALL""")
def monitor_report(spark, sf):
    return monitor.monitor_report(monitor.decide_events(
        syscalls(table(spark, sf, "events")), policy.policy_table(spark)))


@query("monitor_summary", "WITH " + EVENTS_SQL + ", " + RULES_SQL + """,
z AS (SELECT level, count(*) FILTER (action = 'allow') AS n_allow, count(*) FILTER (action = 'block') AS n_block,
  count(*) FILTER (action = 'kill') AS n_kill FROM rules GROUP BY level),
seen AS (SELECT level, count(*) AS n_events FROM ev GROUP BY level)
SELECT z.level, d.decision, n_allow, n_block, n_kill, n_events,
  CASE WHEN d.decision IN ('allow_with_audit', 'sandbox') THEN 'on' ELSE 'off' END AS audit,
  'monitor[' || z.level || '] decision=' || d.decision || '; allow=' || n_allow || ' syscalls, block=' || n_block || ', audit='
  || CASE WHEN d.decision IN ('allow_with_audit', 'sandbox') THEN 'on' ELSE 'off' END AS summary
FROM z JOIN dflt d ON d.level = z.level JOIN seen ON seen.level = z.level""")
def monitor_summary(spark, sf):
    """The rule summary of every level that the events run under."""
    seen = syscalls(table(spark, sf, "events")).groupBy("level").agg(F.count(F.lit(1)).alias("n_events"))
    return monitor.monitor_summary(policy.policy_table(spark)).join(seen, "level")
