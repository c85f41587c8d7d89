"""Corpus building, learning, evasion, text baselines, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..operators import gramtotals, hygiene, learning, metrics as M, monitor, mutate, scoring, splits, stats, textml
from ..operators.scoring import RiskModel
from ..session import shared_path
from ..sources import corpus as sources
from ..sources.synthesize import CORPUS_COLUMNS, manifest_stats as stats_columns, synthesize_corpus
from ..streaming import jobs
from . import sqlbase as Q
from .metric_queries import (DECIDED_COLUMNS, EVENTS_SQL, FOLDED, METRIC_COLUMNS, PAIRED, RULES_SQL, areas_sql, binomial_p,
                             cells, mcnemar_columns, mcnemar_row, metric_exprs, metric_row, split_sql, syscalls, wilson_sql)
from .registry import (BENIGN, CHECKS, HOLDOUT, SCORED, benign, corpus, d6, holdout, query, r6, scored, spread, spread_texts,
                       table)

SCRIPTS = Q.scripts()


# -- §2.1 ----------------------------------------------------------------------
@query("synthesize_corpus", Q.with_(SCRIPTS) + "SELECT * FROM scripts")
def synthesize(spark, sf):
    return corpus(spark, sf)


@query("dedup_exact", Q.with_(Q.scripts("lineitem", "l_orderkey")) + """
SELECT template, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT id, template, row_number() OVER (PARTITION BY sha256(script) ORDER BY id) AS rn FROM scripts)
WHERE rn = 1 GROUP BY template""")
def dedup_exact(spark, sf):
    """Line items of one order repeat its key, so their scripts are copies."""
    rows = synthesize_corpus(spread(table(spark, sf, "lineitem"), "l_orderkey"), "l_orderkey")
    kept = hygiene.dedup_exact(rows.select("id", "template", "script"))
    return kept.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
                                        F.max("id").alias("last_id"))


@query("dedup_documents", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def dedup_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return hygiene.dedup_exact(docs, "text", "doc_id").select("doc_id", "source")


@query("manifest_stats", """
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'dangerous' WHEN l.toxic IS NOT NULL THEN 'safe' END AS label_name, length(text)::INTEGER AS n_chars,
  (length(text) - length(replace(text, chr(10), '')))::INTEGER AS n_lines FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def manifest_stats(spark, sf):
    """Sizes of every document; those without a label have none."""
    docs = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "left")
    return stats_columns(docs, "text").select("doc_id", "label_name", "n_chars", "n_lines")


# Assistant turns carry a script: fenced, bare, or none, by the turn's digest.
_FENCE = "```"
REPLIES = ("replies AS (SELECT c.conv_id, c.turn, c.role, CASE "
           f"WHEN v < 6 THEN c.text || chr(10) || '{_FENCE}' || ['bash', 'sh', '', 'python'][v % 4 + 1] || chr(10) || s.script || '{_FENCE}' || chr(10) || c.text "
           "WHEN v < 8 THEN s.script ELSE c.text END AS text FROM (SELECT *, "
           + Q.hexnum(Q.md5("'reply'", "conv_id", "turn"), 1, 2) + " % 10 AS v FROM conversations) c "
           "JOIN conv_scripts s ON s.key = c.conv_id * 1000 + c.turn)")
CONV = Q.scripts("(SELECT conv_id * 1000 + turn AS ck FROM conversations)", "ck", 5, "c_", "cs") + """,
conv_scripts AS (SELECT split_part(id, '_', -1)::BIGINT AS key, script FROM cs)"""
_EXTRACTED = (f"CASE WHEN len(regexp_extract_all(text, {Q.lit('(?s)' + K.FENCE_PATTERN)}, 1)) > 0 "
              f"THEN nullif({Q.strip('regexp_extract(text, ' + Q.lit('(?s)' + K.FENCE_PATTERN) + ', 1)')}, '') "
              f"WHEN starts_with({Q.strip('text')}, '#!') THEN {Q.strip('text')} END")


def replies(spark, sf):
    from ..functions.hashing import digest, hex_number

    conv = table(spark, sf, "conversations")
    made = synthesize_corpus(conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ck")), "ck", 5, "c_")
    made = made.select(F.element_at(F.split("id", "_"), -1).cast("bigint").alias("ck"), "script")
    v = F.pmod(hex_number(digest("reply", F.col("conv_id"), F.col("turn")), 1, 2), F.lit(10)).cast("int")
    tag = F.element_at(F.array(F.lit("bash"), F.lit("sh"), F.lit(""), F.lit("python")), v % 4 + 1)
    both = conv.withColumn("ck", F.col("conv_id") * 1000 + F.col("turn")).join(made, "ck")
    fenced = F.concat(F.col("text"), F.lit("\n" + _FENCE), tag, F.lit("\n"), F.col("script"), F.lit(_FENCE + "\n"), F.col("text"))
    return both.select("conv_id", "turn", "role", F.when(v < 6, fenced).when(v < 8, F.col("script")).otherwise(
        F.col("text")).alias("text"))


@query("extract_script", Q.with_(CONV, REPLIES) + f"SELECT conv_id, turn, {_EXTRACTED} AS script FROM replies")
def extract_script(spark, sf):
    return replies(spark, sf).select("conv_id", "turn", sources.extract_script(F.col("text")).alias("script"))


@query("conversations_to_corpus", Q.with_(CONV, REPLIES) + f""", k AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, {_EXTRACTED} AS script,
    (SELECT arg_max(q.text, q.turn) FROM replies q WHERE q.conv_id = replies.conv_id AND q.role = 'user' AND q.turn < replies.turn) AS prompt
  FROM replies WHERE role = 'assistant')
SELECT sid AS id, 'scripts/' || sid || '.sh' AS path, 'local:assistant' AS provenance, length(script)::INTEGER AS n_chars, prompt, script
FROM (SELECT printf('llm_local_%03d_%d', conv_id, k) AS sid, prompt, script FROM k WHERE script IS NOT NULL)""")
def conversations_to_corpus(spark, sf):
    return sources.conversations_to_corpus(replies(spark, sf))


@query("pending_annotation", """
SELECT d.doc_id AS id, substr(text, 1, 400) AS shown, greatest(length(text) - 400, 0)::INTEGER AS remaining_chars
FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_annotation(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return hygiene.pending_annotation(docs, done, 400, "text").select("id", "shown", "remaining_chars")


@query("exact_overlap", """
SELECT d.doc_id, d.source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)
  AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def exact_overlap(spark, sf):
    """Labelled documents that also occur among the others."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    ids = table(spark, sf, "labels").select("doc_id")
    a, b = docs.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_anti")
    return hygiene.exact_overlap(a, b).select("doc_id", "source")


_WORDS = r"regexp_extract_all(lower(text), '\S+')"
SHINGLE_SQL = f"""sh AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS held, list_distinct(
    CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
a AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh WHERE held), b AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh WHERE NOT held),
shared AS (SELECT a.doc_id AS da, b.doc_id AS db, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM a JOIN b ON a.g = b.g GROUP BY ALL),
best AS (SELECT da, max(c / (na + nb - c)::DOUBLE) AS similarity FROM shared GROUP BY da)"""


@query("near_duplicates", f"WITH {SHINGLE_SQL} SELECT da AS id, {d6('similarity')} AS similarity FROM best WHERE similarity >= 0.85")
def near_duplicates(spark, sf):
    """Labelled documents that nearly repeat one of the others."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    a, b = docs.join(ids, "id", "left_semi"), docs.join(ids, "id", "left_anti")
    return hygiene.near_duplicates(a, b, 0.85).select("id", r6("similarity").alias("similarity"))


# -- readers and writers: a round trip through files of the shared folder ---------
@query("read_corpus", Q.with_(Q.scripts("supplier", "s_suppkey", 9, "f_")) + """
SELECT id, category, label, rationale, template, script FROM scripts""")
def read_corpus(spark, sf):
    base = shared_path(spark, "bodies")
    rows = synthesize_corpus(table(spark, sf, "supplier"), "s_suppkey", 9, "f_")
    sources.write_bodies(rows, base)
    sources.write_manifest(rows, f"{base}-index")
    return sources.read_corpus(spark, f"{base}-index/manifest.jsonl", base).select(
        "id", "category", "label", "rationale", "template", "script")


@query("read_corpus_lenient", Q.with_(Q.scripts("supplier", "s_suppkey", 9, "f_")) + """
SELECT id, category, label, template, script FROM scripts WHERE label = 1""")
def read_corpus_lenient(spark, sf):
    """Only the dangerous bodies are there; the rest of the manifest drops out."""
    base = shared_path(spark, "bodies")
    rows = synthesize_corpus(table(spark, sf, "supplier"), "s_suppkey", 9, "f_")
    sources.write_bodies(rows.filter("label = 1"), base)
    sources.write_manifest(rows, f"{base}-index")
    return sources.read_corpus(spark, f"{base}-index/manifest.jsonl", base, strict=False).select(
        "id", "category", "label", "template", "script")


@query("read_labels", """
SELECT CAST(doc_id AS VARCHAR) AS id, toxic AS label FROM labels""")
def read_labels(spark, sf):
    """Each id is written twice; the later line holds the valid label."""
    path = shared_path(spark, "labels")
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), "toxic")
    lines = rows.select(F.explode(F.array(
        F.to_json(F.struct("id", (1 - F.col("toxic")).alias("label"), F.lit("A").alias("annotator"))), F.lit(""),
        F.to_json(F.struct("id", F.col("toxic").alias("label"), F.lit("A").alias("annotator"))))).alias("value"))
    lines.write.text(path)
    return sources.read_labels(spark, path)


@query("load_signatures", Q.with_(SCRIPTS, Q.flags_cte("scripts")) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {Q.lit(s[0])} AS id, {Q.lit(s[1])} AS category, {float(s[2])!r}::DOUBLE AS weight, {Q.lit(s[3])} AS regex, "
    f"count(*) FILTER (sig_{s[0]}) AS n_rows FROM flagged" for s in K.SIGNATURES) + ")")
def load_signatures(spark, sf):
    """The knowledge base as a JSON document, read back, with its hits in the corpus."""
    from ..operators import signatures

    path = shared_path(spark, "kb")
    rows = signatures.signature_table(spark)
    doc = rows.groupBy().agg(F.array_agg(F.struct("id", "category", "weight", "regex", "rationale")).alias("signatures"))
    doc.select(F.to_json(F.struct(F.lit("1").alias("version"), "signatures")).alias("value")).coalesce(1).write.text(path)
    used = signatures.signature_usage(corpus(spark, sf)).select(F.col("signature_id").alias("id"), "n_rows")
    return sources.load_signatures(spark, path).select("id", "category", "weight", "regex").join(used, "id")


@query("read_prompts", f"""
SELECT prompt, count(*) AS n FROM (SELECT {Q.strip('unnest(string_split(text, chr(10)))')} AS prompt FROM benchmark)
WHERE prompt <> '' AND NOT starts_with(prompt, '#') GROUP BY prompt""")
def read_prompts(spark, sf):
    path = shared_path(spark, "prompts")
    table(spark, sf, "benchmark").select(F.concat(F.lit("# item\n\n"), F.col("text"))).write.text(path)
    return sources.read_prompts(spark, path).groupBy("prompt").agg(F.count(F.lit(1)).alias("n"))


@query("write_manifest", Q.with_(SCRIPTS) + """
SELECT id, category, label, label_name, rationale, template, path, provenance, n_chars, n_lines FROM scripts""")
def write_manifest(spark, sf):
    """The manifest written as JSONL and CSV, and read back from the CSV."""
    path = shared_path(spark, "manifest")
    rows = corpus(spark, sf)
    sources.write_manifest(rows, path)
    return spark.read.schema(rows.drop("script").schema).option("header", True).csv(f"{path}/manifest.csv")


@query("write_results", Q.with_(SCORED) + f"""
SELECT level, count(*) AS n, {d6('avg(risk)')} AS mean_risk, sum(len(commands))::BIGINT AS n_commands FROM scored GROUP BY level""")
def write_results(spark, sf):
    """Every result as a JSON document, read back and summed."""
    path = shared_path(spark, "results")
    sources.write_results(scoring.analyze(corpus(spark, sf).select("id", "script")), path)
    doc = spark.read.schema("parsed struct<commands:array<string>>, assessment struct<risk:double,level:string>").json(path)
    return doc.groupBy(F.col("assessment.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("assessment.risk")).alias("mean_risk"),
        F.sum(F.size("parsed.commands")).alias("n_commands"))


# -- §2.8 ----------------------------------------------------------------------
_BCE = "-(label * ln(least(1 - 1e-12, greatest(1e-12, {p}))) + (1 - label) * ln(1 - least(1 - 1e-12, greatest(1e-12, {p}))))"


@query("bce_loss", Q.with_(SCORED) + f"SELECT category, {d6(f'avg({_BCE.format(p='risk')})')} AS loss FROM scored GROUP BY category")
def bce_loss(spark, sf):
    return learning.bce_loss(scored(spark, sf), ["category"]).select("category", r6("loss").alias("loss"))


@query("gradient", Q.with_(SCORED) + "SELECT " + ", ".join(
    f"{d6(f'sum((risk - label) * {f})')} AS g_{f}" for f in K.FEATURES) + f", {d6('sum(risk - label)')} AS g_bias, count(*) AS n FROM scored")
def gradient(spark, sf):
    out = learning.gradient(scoring.features_for(corpus(spark, sf).select("label", "script")))
    return out.select(*[r6(c).alias(c) for c in out.columns if c != "n"], "n")


EPOCHS = 40


def train_sql() -> str:
    lr, l2 = learning.BATCH_RATE, learning.L2
    w = {f: f"w{i}" for i, f in enumerate(K.FEATURES)}
    z = "b" + "".join(f" + {w[f]} * {f}" for f in K.FEATURES)
    keys = ", ".join(w.values())
    steps = ", ".join(f"{w[f]} - {lr} * (sum(k * (p - label) * {f}) / sum(k) + {l2} * {w[f]})" for f in K.FEATURES)
    start = ", ".join(f"{K.DEFAULT_WEIGHTS[f]}::DOUBLE" for f in K.FEATURES)
    feats = ", ".join(K.FEATURES)
    final = " UNION ALL ".join(f"SELECT '{f}' AS name, {w[f]} AS value FROM fin" for f in K.FEATURES)
    delta = " + ".join(f"power({w[f]} - {K.DEFAULT_WEIGHTS[f]}, 2)" for f in K.FEATURES)
    body = Q.with_(SCORED).replace("WITH ", "WITH RECURSIVE ", 1)
    return body + f""", ft AS MATERIALIZED (SELECT label, {feats}, count(*)::DOUBLE AS k FROM scored GROUP BY label, {feats}),
run(epoch, {keys}, b, loss) AS (SELECT 0, {start}, {K.DEFAULT_BIAS}::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT epoch + 1, {steps}, b - {lr} * sum(k * (p - label)) / sum(k), sum(k * {_BCE.format(p='p')}) / sum(k)
  FROM (SELECT run.*, ft.*, {Q.sigmoid(z)} AS p FROM run, ft WHERE epoch < {EPOCHS}) GROUP BY epoch, {keys}, b),
fin AS (SELECT * FROM run WHERE epoch = {EPOCHS})
SELECT name, {d6('value')} AS value FROM ({final} UNION ALL SELECT 'bias', b FROM fin
  UNION ALL SELECT 'loss_' || epoch, loss FROM run WHERE epoch > 0
  UNION ALL SELECT 'weight_delta_norm', sqrt({delta} + power(b - {K.DEFAULT_BIAS}, 2)) FROM fin)"""


@query("train", train_sql())
def train(spark, sf):
    """Forty epochs on the whole corpus: weights, bias, loss history, change norm."""
    run = learning.train(scoring.features_for(corpus(spark, sf).select("label", "script")), epochs=EPOCHS)
    weights = scoring.model_table(spark, run.model).filter("feature <> 'threshold'").select(
        F.col("feature").alias("name"), F.col("weight").alias("value"))
    losses = learning.training_log(spark, run).select(
        F.concat(F.lit("loss_"), F.col("epoch").cast("string")).alias("name"), F.col("loss").alias("value"))
    norm = spark.createDataFrame([("weight_delta_norm", run.weight_delta_norm)], "name string, value double")
    return weights.unionByName(losses).unionByName(norm).withColumn("value", r6("value"))


def split_scripts(spark, sf, source=corpus):
    return learning.split_frames(source(spark, sf).select("id", "category", "label", "template", "script"))


def _metric_columns(out, extra=()):
    return out.select("config", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in
                      [*M.METRICS, "roc_auc", "pr_auc", "decision_threshold", "initial_loss", "final_loss",
                       "weight_delta_norm", *extra]])


STUDY_EPOCHS = 40


W = {f: f"w{i}" for i, f in enumerate(K.FEATURES)}
WEIGHTED = "b" + "".join(f" + {W[f]} * {f}" for f in K.FEATURES)


def descent_sql(name: str, rows: str, start: str, epochs: int) -> str:
    """CTE ``name``: one row of weights after ``epochs`` full-batch steps on ``rows`` from
    the one row of ``start``."""
    lr, l2, keys, feats = learning.BATCH_RATE, learning.L2, ", ".join(W.values()), ", ".join(K.FEATURES)
    steps = ", ".join(f"{w} - {lr} * (sum(k * (p - label) * {f}) / sum(k) + {l2} * {w})" for f, w in W.items())
    return f"""{name}_rows AS MATERIALIZED (SELECT label, {feats}, count(*)::DOUBLE AS k FROM {rows} GROUP BY label, {feats}),
{name}_run(epoch, {keys}, b) AS (SELECT 0, {keys}, b FROM {start}
  UNION ALL SELECT epoch + 1, {steps}, b - {lr} * sum(k * (p - label)) / sum(k)
  FROM (SELECT r.*, f.*, {Q.sigmoid(WEIGHTED)} AS p FROM {name}_run r, {name}_rows f WHERE epoch < {epochs}) GROUP BY epoch, {keys}, b),
{name} AS MATERIALIZED (SELECT {keys}, b FROM {name}_run WHERE epoch = {epochs})"""


START_SQL = "start AS (SELECT " + ", ".join(
    f"{K.DEFAULT_WEIGHTS[f]}::DOUBLE AS {w}" for f, w in W.items()) + f", {K.DEFAULT_BIAS}::DOUBLE AS b)"


def fitted_sql(config: str, off: tuple = (), learn: bool = True) -> str:
    """CTEs of one configuration fitted on ``train`` and applied to ``test``:
    ``<config>_out`` with its test rows, ``<config>_log`` with one row about the fit."""
    gone = {f for group in off for f in K.FEATURE_GROUPS[group]}
    used = {f: w for f, w in W.items() if f not in gone}
    z = "b" + "".join(f" + {w} * {f}" for f, w in used.items())
    lr, l2, keys = learning.BATCH_RATE, learning.L2, ", ".join(W.values())
    steps = ", ".join(f"{w} - {lr} * (sum(k * (p - label) * {f}) / sum(k) + {l2} * {w})" if f in used else w for f, w in W.items())
    norm = " + ".join([*(f"power({w} - {K.DEFAULT_WEIGHTS[f]}, 2)" for f, w in W.items()), f"power(b - {K.DEFAULT_BIAS}, 2)"])
    epochs = STUDY_EPOCHS if learn else 0
    fit = f"""{config}_run(epoch, {keys}, b, loss) AS (SELECT 0, {keys}, b, NULL::DOUBLE FROM start
  UNION ALL SELECT epoch + 1, {steps}, b - {lr} * sum(k * (p - label)) / sum(k), sum(k * {_BCE.format(p='p')}) / sum(k)
  FROM (SELECT r.*, f.*, {Q.sigmoid(z)} AS p FROM {config}_run r, train_rows f WHERE epoch < {epochs}) GROUP BY epoch, {keys}, b),
{config}_fin AS MATERIALIZED (SELECT * FROM {config}_run WHERE epoch = {epochs}),
{config}_own AS MATERIALIZED (SELECT label, k, {Q.sigmoid(z)} AS risk FROM train_rows, {config}_fin),
{config}_cand AS (SELECT DISTINCT {Q.half_even('risk', 3)} AS thr FROM {config}_own UNION SELECT 0.5),
{config}_tried AS (SELECT thr, coalesce(sum(k) FILTER (risk >= thr AND label = 1), 0) AS tp, coalesce(sum(k) FILTER (risk >= thr AND label = 0), 0) AS fp,
  coalesce(sum(k) FILTER (risk < thr AND label = 1), 0) AS fn, coalesce(sum(k) FILTER (risk < thr AND label = 0), 0) AS tn
  FROM {config}_cand, {config}_own GROUP BY thr),
{config}_thr AS MATERIALIZED (SELECT thr FROM (SELECT thr, {metric_exprs()['f1']} AS metric FROM {config}_tried) ORDER BY metric DESC, thr LIMIT 1)"""
    threshold = f"(SELECT thr FROM {config}_thr)" if learn else f"{K.DEFAULT_THRESHOLD}"
    return fit + f""",
{config}_log AS (SELECT '{config}' AS config, {threshold}::DOUBLE AS decision_threshold,
  (SELECT loss FROM {config}_run WHERE epoch = 1) AS initial_loss,
  (SELECT loss FROM {config}_run WHERE epoch = {epochs} AND epoch > 0) AS final_loss, sqrt({norm}) AS weight_delta_norm FROM {config}_fin),
{config}_out AS (SELECT '{config}' AS config, id, label, risk, risk >= {threshold} AS p
  FROM (SELECT id, label, {Q.sigmoid(z)} AS risk FROM test, {config}_fin))"""


def configs_ctes(configs: list[tuple[str, tuple, bool]]) -> str:
    """``outs`` with the test rows of every fitted configuration, ``logs`` about the fits."""
    names = [name for name, _, _ in configs]
    return recursive(
        SCORED, split_sql("scripts"), START_SQL,
        "train_rows AS MATERIALIZED (SELECT s.label, " + ", ".join(f"s.{f}" for f in K.FEATURES) + """, count(*)::DOUBLE AS k
  FROM scored s JOIN sp ON sp.id = s.id WHERE sp.split = 'train' GROUP BY s.label, """ + ", ".join(f"s.{f}" for f in K.FEATURES) + ")",
        f"test AS MATERIALIZED (SELECT s.id, s.label, {', '.join('s.' + f for f in K.FEATURES)} FROM scored s JOIN sp ON sp.id = s.id WHERE sp.split = 'test')",
        *(fitted_sql(*c) for c in configs),
        "outs AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {n}_out" for n in names) + ")",
        "logs AS (" + " UNION ALL ".join(f"SELECT * FROM {n}_log" for n in names) + ")")


def configs_sql(configs: list[tuple[str, tuple, bool]], delta: bool = False) -> str:
    """One metric row per configuration."""
    body = configs_ctes(configs) + f""",
c AS (SELECT config, {cells(p='p')} FROM outs GROUP BY config), m AS (SELECT *, {metric_exprs()['f1']} AS f FROM c)"""
    extra = f", {d6(chr(102) + ' - (SELECT f FROM m WHERE config = ' + chr(39) + 'full' + chr(39) + ')')} AS delta_f1" if delta else ""
    return body + areas_sql("config", "outs") + f"""
SELECT m.config, tp, fp, tn, fn, {METRIC_COLUMNS}, {d6('roc')} AS roc_auc, {d6('pr')} AS pr_auc,
  {d6('decision_threshold')} AS decision_threshold, {d6('initial_loss')} AS initial_loss, {d6('final_loss')} AS final_loss,
  {d6('weight_delta_norm')} AS weight_delta_norm{extra}
FROM m JOIN logs ON logs.config = m.config LEFT JOIN areas ON areas.config = m.config"""


def folds_sql() -> str:
    """Per fold the metrics of the model fitted on the other folds."""
    lr, l2, keys, feats = learning.BATCH_RATE, learning.L2, ", ".join(W.values()), ", ".join(K.FEATURES)
    steps = ", ".join(f"{w} - {lr} * (sum(k * (p - label) * {f}) / sum(k) + {l2} * {w})" for f, w in W.items())
    return FOLDED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {START_SQL},
ft AS MATERIALIZED (SELECT fold AS own, label, {feats}, count(*)::DOUBLE AS k FROM rows GROUP BY ALL),
run(fold, epoch, {keys}, b) AS (SELECT fold, 0, {keys}, b FROM start, (SELECT unnest(range(5))::INTEGER AS fold)
  UNION ALL SELECT fold, epoch + 1, {steps}, b - {lr} * sum(k * (p - label)) / sum(k)
  FROM (SELECT r.*, f.*, {Q.sigmoid(WEIGHTED)} AS p FROM run r JOIN ft f ON f.own <> r.fold WHERE epoch < {STUDY_EPOCHS})
  GROUP BY fold, epoch, {keys}, b),
oof AS MATERIALIZED (SELECT fold, label, {Q.sigmoid(WEIGHTED)} AS risk FROM (
  SELECT r.fold, r.label, {', '.join('r.' + f for f in K.FEATURES)}, {', '.join('run.' + w for w in W.values())}, run.b
  FROM rows r JOIN run ON run.fold = r.fold AND run.epoch = {STUDY_EPOCHS})),
c AS (SELECT fold, {cells(p='risk >= 0.5')} FROM oof GROUP BY fold)""" + areas_sql("fold", "oof") + f"""
SELECT c.fold, tp, fp, tn, fn, {METRIC_COLUMNS}, {d6('roc')} AS roc_auc, {d6('pr')} AS pr_auc
FROM c LEFT JOIN areas ON areas.fold = c.fold"""


def tuned_sql(rows: str, model: str) -> str:
    """CTE ``tuned``: the threshold of the best F1 of ``model`` on ``rows``."""
    return f"""own AS MATERIALIZED (SELECT label, {Q.sigmoid(WEIGHTED)} AS risk FROM {rows}, {model}),
cand AS (SELECT DISTINCT {Q.half_even('risk', 3)} AS thr FROM own UNION SELECT 0.5),
hist AS (SELECT risk, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM own GROUP BY risk),
tried AS (SELECT thr, coalesce(sum(pos) FILTER (risk >= thr), 0) AS tp, coalesce(sum(neg) FILTER (risk >= thr), 0) AS fp,
  coalesce(sum(pos) FILTER (risk < thr), 0) AS fn, coalesce(sum(neg) FILTER (risk < thr), 0) AS tn FROM cand, hist GROUP BY thr),
tuned AS MATERIALIZED (SELECT thr FROM (SELECT thr, {metric_exprs()['f1']} AS metric FROM tried) ORDER BY metric DESC, thr LIMIT 1)"""


def recursive(*ctes: str) -> str:
    return Q.with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("train_and_eval", configs_sql([("model", (), True)]))
def train_and_eval(spark, sf):
    return _metric_columns(learning.train_and_eval(*split_scripts(spark, sf), epochs=STUDY_EPOCHS))


STUDY_CONFIGS = [(name, tuple(off), True) for name, off in K.ABLATIONS] + [("no_feedback", (), False)]


@query("run_ablation", configs_sql(STUDY_CONFIGS, delta=True))
def run_ablation(spark, sf):
    return _metric_columns(learning.run_ablation(*split_scripts(spark, sf), epochs=STUDY_EPOCHS), ["delta_f1"])


@query("ablation_significance", configs_ctes(STUDY_CONFIGS) + f""",
pr AS (SELECT x.config, (f.p::INTEGER = x.label) AS ca, (x.p::INTEGER = x.label) AS cb
  FROM outs x JOIN outs f ON f.id = x.id AND f.config = 'full' WHERE x.config <> 'full'),
k AS (SELECT config, {PAIRED} FROM pr GROUP BY config),
cl AS (SELECT config, {cells(p='p')} FROM outs GROUP BY config), m AS (SELECT config, {metric_exprs()['f1']} AS f1 FROM cl),
q AS (SELECT k.*, {binomial_p('least(b, c)', '(b + c)')} AS pv FROM k)
SELECT q.config, {mcnemar_columns('pv')}, {d6('m.f1')} AS f1,
  round(m.f1 - (SELECT f1 FROM m WHERE config = 'full'), 4) AS delta_f1 FROM q JOIN m ON m.config = q.config""")
def ablation_significance(spark, sf):
    """Every ablation fitted anew and the model without learning, against the full one, on the test split."""
    train_rows, test_rows = split_scripts(spark, sf)
    runs = learning.fit_configs(train_rows, STUDY_CONFIGS, epochs=STUDY_EPOCHS)
    decisions = {name: scoring.sigmoid(scoring.logit(r.model)) >= r.model.threshold for name, r in runs.items()}
    out = stats.ablation_significance(scoring.features_for(test_rows), decisions)
    return mcnemar_row(out, ("config", r6("f1").alias("f1"), "delta_f1"))


CONFIG_ROWS = " UNION ALL ".join(
    f"SELECT id, label, '{name}' AS config, {Q.sigmoid(Q.logit(off))} >= 0.5 AS p FROM features" for name, off in K.ABLATIONS)


@query("ablation_table", Q.with_(SCORED) + f""", cfg AS ({CONFIG_ROWS}), c AS (SELECT config, {cells(p='p')} FROM cfg GROUP BY config),
m AS (SELECT *, {metric_exprs()['f1']} AS f FROM c)
SELECT config, tp, fp, tn, fn, {METRIC_COLUMNS}, {d6("f - (SELECT f FROM m WHERE config = 'full')")} AS delta_f1 FROM m""")
def ablation_table(spark, sf):
    out = learning.ablation_table(scored(spark, sf))
    return metric_row(out.withColumn("delta_f1", r6("delta_f1")), ("config", "delta_f1"))


@query("cross_validate", folds_sql())
def cross_validate(spark, sf):
    """Leave-template-out folds: per-fold metrics of models fitted on the other folds."""
    rows = scored(spark, sf).select("id", "label", "template", *K.FEATURES)
    folds = splits.grouped_folds(rows.select("id", "label", "template"))
    per_fold, _ = learning.cross_validate(rows, folds, 5, epochs=STUDY_EPOCHS)
    return per_fold.select("fold", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in [*M.METRICS, "roc_auc", "pr_auc"]])


@query("holdout_eval", Q.with_(HOLDOUT) + f"""
SELECT id, category, label, {d6('risk')} AS risk, (risk >= 0.319)::INTEGER AS predicted, ((risk >= 0.319)::INTEGER = label) AS correct FROM scored_h""")
def holdout_eval(spark, sf):
    rows = holdout(spark, sf).select("id", "category", "label", "script")
    return learning.holdout_eval(rows, RiskModel(threshold=0.319)).withColumn("risk", r6("risk"))


@query("holdout_eval_trained", recursive(
    SCORED, HOLDOUT, START_SQL, descent_sql("fin", "scored", "start", STUDY_EPOCHS), tuned_sql("scored", "fin")) + f"""
SELECT id, category, label, {d6('p')} AS risk, (p >= thr)::INTEGER AS predicted, ((p >= thr)::INTEGER = label) AS correct
FROM (SELECT id, category, label, {Q.sigmoid(WEIGHTED)} AS p FROM scored_h, fin), tuned""")
def holdout_eval_trained(spark, sf):
    """Fitted and tuned on the study corpus, frozen, then one pass over the holdout."""
    model = learning.fit_on(corpus(spark, sf).select("label", "script"), epochs=STUDY_EPOCHS)
    out = learning.holdout_eval(holdout(spark, sf).select("id", "category", "label", "script"), model)
    return out.withColumn("risk", r6("risk"))


def study_detectors(model) -> dict[str, RiskModel]:
    """The masks at default weights, and the model fitted and tuned on the study corpus."""
    return {name: RiskModel(disabled=tuple(off)) for name, off in K.ABLATIONS} | {"fitted": model}


@query("external_fpr", recursive(
    SCORED, BENIGN, START_SQL, descent_sql("fin", "scored", "start", STUDY_EPOCHS), tuned_sql("scored", "fin"),
    "cfg AS (" + " UNION ALL ".join(
        f"SELECT '{name}' AS detector, {Q.sigmoid(Q.logit(off))} >= 0.5 AS p FROM features_x WHERE label = 0" for name, off in K.ABLATIONS)
    + f" UNION ALL SELECT 'fitted', {Q.sigmoid(WEIGHTED)} >= thr FROM features_x, fin, tuned WHERE label = 0)",
    "k AS (SELECT detector, count(*) FILTER (p) AS n_flagged, count(*) AS n_benign FROM cfg GROUP BY detector)") + f"""
SELECT detector, n_flagged, n_benign, round(n_flagged / n_benign, 3) AS fpr,
  {', '.join(f'{d6(e)} AS {c}' for c, e in wilson_sql('n_flagged', 'n_benign').items() if c != 'wilson_point')} FROM k""")
def external_fpr(spark, sf):
    """False positives on a benign corpus that no detector has seen."""
    model = learning.fit_on(corpus(spark, sf).select("label", "script"), epochs=STUDY_EPOCHS)
    return _fpr_columns(learning.external_fpr(benign(spark, sf).select("id", "label", "script"), study_detectors(model)))


def _fpr_columns(out):
    return out.select("detector", "n_flagged", "n_benign", "fpr", r6("wilson_low").alias("wilson_low"),
                      r6("wilson_high").alias("wilson_high"))


@query("concept_drift", recursive(
    SCORED, START_SQL, "base AS MATERIALIZED (SELECT * FROM scored WHERE category <> 'obfuscated')",
    f"""novel AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(id), id) AS place FROM scored
  WHERE category = 'obfuscated' AND label = 1)""",
    "adapt AS (SELECT * FROM novel WHERE place % 2 = 1)", "held AS (SELECT * FROM novel WHERE place % 2 = 0)",
    descent_sql("fin", "base", "start", STUDY_EPOCHS), descent_sql("moved", "adapt", "fin", 5), tuned_sql("base", "fin"),
    *(f"{name}_recall AS (SELECT avg(({Q.sigmoid(WEIGHTED)} >= thr)::INTEGER::DOUBLE) AS r FROM held, {name}, tuned)"
      for name in ("fin", "moved"))) + f"""
SELECT 'obfuscated' AS drift_category, (SELECT count(*) FROM base) AS n_base_train, (SELECT count(*) FROM adapt) AS n_adapt,
  (SELECT count(*) FROM held) AS n_eval, {d6('f.r')} AS frozen_recall, {d6('m.r')} AS online_recall,
  {d6('m.r - f.r')} AS recall_recovered FROM fin_recall f, moved_recall m""")
def concept_drift(spark, sf):
    out = learning.concept_drift(scored(spark, sf).select("id", "category", "label", *K.FEATURES), epochs=STUDY_EPOCHS)
    return out.select("drift_category", "n_base_train", "n_adapt", "n_eval",
                      *[r6(c).alias(c) for c in ("frozen_recall", "online_recall", "recall_recovered")])


def flips_sql() -> str:
    """Every dangerous row takes its own steps until it falls below the threshold."""
    lr, l2 = learning.STEP_RATE, learning.L2
    w = {f: f"w{i}" for i, f in enumerate(K.FEATURES)}
    names, feats = ", ".join(w.values()), ", ".join(K.FEATURES)
    start = ", ".join(f"{K.DEFAULT_WEIGHTS[f]}::DOUBLE" for f in K.FEATURES)
    steps = ", ".join(f"{w[f]} - {lr} * (risk * {f} + {l2} * {w[f]}) AS {w[f]}" for f in K.FEATURES)
    z = "b" + "".join(f" + {w[f]} * {f}" for f in K.FEATURES)
    return Q.with_(SCORED).replace("WITH ", "WITH RECURSIVE ", 1) + f""", own AS MATERIALIZED (
  SELECT id, category, template, risk AS first_risk, {feats} FROM scored WHERE label = 1),
st(id, k, {names}, b, risk) AS (
  SELECT id, 0, {start}, {K.DEFAULT_BIAS}::DOUBLE, first_risk FROM own
  UNION ALL SELECT id, k, {names}, b, {Q.sigmoid(z)} FROM (
    SELECT id, k + 1 AS k, {steps}, b - {lr} * risk AS b, {feats} FROM st JOIN own USING (id)
    WHERE risk >= {K.DEFAULT_THRESHOLD} AND k < 50))
SELECT id, category, template, {d6('first_risk')} AS start_risk,
  (SELECT min(k) FROM st WHERE st.id = own.id AND risk < {K.DEFAULT_THRESHOLD})::INTEGER AS updates_to_flip FROM own"""


@query("flips_to_safe", flips_sql())
def flips_to_safe(spark, sf):
    return learning.flips_to_safe(scored(spark, sf)).withColumn("start_risk", r6("start_risk"))


# -- §2.13 ----------------------------------------------------------------------
def sql_rewrite(pattern: str, template: str, x: str) -> str:
    out = ""
    import re
    for part in re.split(r"(\\[0-9])", template):
        out += part if re.fullmatch(r"\\[0-9]", part) else part.replace("\\", "\\\\")
    return f"regexp_replace({x}, {Q.lit(pattern)}, {Q.lit(out)}, 'g')"


def sql_camouflage(x: str) -> str:
    return (f"{Q.lit(K.BENIGN_HEADER)} || CASE WHEN starts_with({x}, '#!') THEN "
            f"CASE WHEN contains({x}, chr(10)) THEN substr({x}, instr({x}, chr(10)) + 1) ELSE '' END ELSE {x} END")


def sql_disguise(x: str) -> str:
    for p, t in K.HOST_DISGUISE:
        x = sql_rewrite(p, t, x)
    return x


def sql_all(x: str) -> str:
    for _, p, t in K.SUBSTITUTIONS:
        x = sql_rewrite(p, t, x)
    return x


SQL_DISGUISES = {"benign_camouflage": sql_camouflage("script"), "lexical_disguise": sql_disguise("script"),
                 "both": sql_disguise("(" + sql_camouflage("script") + ")")}
SQL_ATTACKS = {**{n: sql_rewrite(p, t, "script") for n, p, t in K.SUBSTITUTIONS}, "all_transforms": sql_all("script")}

for _name, _fn in {**mutate.DISGUISES, **mutate.ATTACKS}.items():
    def _rewrite(spark, sf, fn=_fn):
        return corpus(spark, sf).select("id", fn(F.col("script")).alias("script"))

    _key = "apply_all" if _name == "all_transforms" else _name
    query(_key, Q.with_(SCRIPTS) + f"SELECT id, {({**SQL_DISGUISES, **SQL_ATTACKS})[_name]} AS script FROM scripts")(_rewrite)


def variant_sql(rewrites: dict, configs, fitted: bool = True) -> str:
    """``rec``: recall of every detector on the rewritten dangerous rows of the test split."""
    source = "FROM sp WHERE label = 1 AND split = 'test'"
    parts = " UNION ALL ".join([f"SELECT id, label, 'original' AS variant, script {source}"] + [
        f"SELECT id, label, '{n}', {e} {source}" for n, e in rewrites.items()])
    preds = " UNION ALL ".join(
        [f"SELECT '{name}' AS detector, variant, {Q.sigmoid(Q.logit(off))} >= 0.5 AS p FROM vf" for name, off in configs]
        + [f"SELECT 'fitted', variant, {Q.sigmoid(WEIGHTED)} >= (SELECT thr FROM fitted_thr) FROM vf, fitted_fin"] * fitted)
    return (configs_ctes([("fitted", (), True)]) + ",\n" + ",\n".join([
        f"v AS MATERIALIZED ({parts})", Q.parsed("v", "vp"), Q.context("vp", "vc"), Q.flags_cte("vc", "vg"),
        Q.features("vg", "vf"), f"pr AS ({preds})",
        "rec AS (SELECT detector, variant, count(*) AS n_dangerous, avg(p::INTEGER) AS recall FROM pr GROUP BY ALL)\n"]))


_RECALL = f"""SELECT r.detector, r.variant, r.n_dangerous, {d6('r.recall')} AS recall, {d6('o.recall - r.recall')} AS "drop"
FROM rec r JOIN rec o ON o.detector = r.detector AND o.variant = 'original'"""


def _recall_columns(out):
    return out.select("detector", "variant", "n_dangerous", r6("recall").alias("recall"), r6("drop").alias("drop"))


@query("variant_recall", variant_sql(SQL_DISGUISES, K.ABLATIONS[:1]) + _RECALL)
def variant_recall(spark, sf):
    """Disguised test rows against the default and the fitted model."""
    train_rows, test_rows = split_scripts(spark, sf)
    fitted = learning.fit_on(train_rows, epochs=STUDY_EPOCHS)
    return _recall_columns(mutate.evasion_budget(test_rows, {"full": RiskModel(), "fitted": fitted}, mutate.DISGUISES))


@query("evasion_budget", variant_sql(SQL_ATTACKS, K.ABLATIONS) + _RECALL)
def evasion_budget(spark, sf):
    """Every substitution of the test rows against all masks and the fitted model."""
    train_rows, test_rows = split_scripts(spark, sf)
    fitted = learning.fit_on(train_rows, epochs=STUDY_EPOCHS)
    return _recall_columns(mutate.evasion_budget(test_rows, study_detectors(fitted)))


@query("recall_by_variant", variant_sql({**SQL_DISGUISES, "all_transforms": SQL_ATTACKS["all_transforms"]}, K.ABLATIONS[3:], fitted=False) + _RECALL)
def recall_by_variant(spark, sf):
    """Variant recall of the model without signatures."""
    rewrites = {**mutate.DISGUISES, "all_transforms": mutate.apply_all}
    _, test_rows = split_scripts(spark, sf)
    return _recall_columns(mutate.evasion_budget(test_rows, {"no_threat": RiskModel(disabled=("threat",))}, rewrites))


# -- §2.12 ----------------------------------------------------------------------
_TOK = r"[\p{L}\p{M}\p{Nd}_]{2,}"
SQL_WORDS = f"regexp_extract_all(lower(text), '{_TOK}')"
SQL_WORD_GRAMS = (f"list_concat({SQL_WORDS}, list_transform(range(1, len({SQL_WORDS})), "
                  f"lambda i: {SQL_WORDS}[i] || ' ' || {SQL_WORDS}[i + 1]))")
SQL_CHAR_GRAMS = (r"flatten(list_transform(regexp_extract_all(lower(text), '\S+'), lambda w: flatten(list_transform("
                  "range(3, least(5, length(w) + 2) + 1), lambda n: list_transform(range(1, length(w) + 2 - n + 2), "
                  "lambda i: substr(' ' || w || ' ', i, n))))))")


def _grams(spark, sf, fn):
    g = fn(F.col("text"))
    return spread_texts(spark, sf).select(
        "doc_id", F.size(g).alias("n"), F.size(F.array_distinct(g)).alias("n_distinct"),
        F.md5(F.array_join(F.array_sort(g), "|")).alias("digest"))


def _gram_sql(expr: str) -> str:
    return (f"SELECT doc_id, len(g)::INTEGER AS n, len(list_distinct(g))::INTEGER AS n_distinct, "
            f"md5(array_to_string(list_sort(g), '|')) AS digest FROM (SELECT doc_id, {expr} AS g FROM documents)")


@query("word_ngrams", "WITH w AS (SELECT doc_id, " + SQL_WORDS + """ AS w FROM documents)
SELECT doc_id, len(g)::INTEGER AS n, len(list_distinct(g))::INTEGER AS n_distinct, md5(array_to_string(list_sort(g), '|')) AS digest
FROM (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w)""")
def word_ngrams(spark, sf):
    return _grams(spark, sf, textml.word_ngrams)


@query("char_wb_ngrams", _gram_sql(SQL_CHAR_GRAMS))
def char_wb_ngrams(spark, sf):
    out = textml.char_wb_digests(spread_texts(spark, sf), "doc_id", "text")
    return out.withColumnRenamed("id", "doc_id")


TFIDF = f"""WITH w AS (SELECT doc_id, text, {SQL_WORDS} AS w FROM documents),
g AS (SELECT doc_id, 'word' AS analyzer, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w
  UNION ALL SELECT doc_id, 'char', unnest({SQL_CHAR_GRAMS}) FROM w),
tf AS MATERIALIZED (SELECT doc_id, analyzer, term, count(*) AS tf FROM g GROUP BY ALL),
vocab AS (SELECT analyzer, term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1 AS idf
  FROM tf GROUP BY ALL HAVING count(*) >= 2),
raw AS (SELECT doc_id, analyzer, term, df, idf, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (analyzer, term)),
norm AS (SELECT doc_id, analyzer, sqrt(sum(w * w)) AS nm FROM raw GROUP BY ALL)
SELECT analyzer, term, df, {d6('any_value(idf)')} AS idf, {d6('sum(w / nm)')} AS total_weight, {d6('max(w / nm)')} AS max_weight
FROM raw JOIN norm USING (doc_id, analyzer) GROUP BY analyzer, term, df"""


@query("tfidf", TFIDF)
def tfidf(spark, sf):
    """TF-IDF of all documents, summed per term."""
    totals = gramtotals.tfidf_totals(table(spark, sf, "documents"), id_col="doc_id", text="text")
    return totals.select("analyzer", "term", "df", *[r6(c).alias(c) for c in ("idf", "total_weight", "max_weight")])


def _text_split(spark, sf):
    """All training rows of the study corpus, which text models are fitted on, and all test rows."""
    return learning.split_frames(corpus(spark, sf).select("id", "category", "label", "script"))


def _baseline(name):
    def run(spark, sf):
        train, test = _text_split(spark, sf)
        out = textml.metric_table(textml.baseline_predictions((name,), train, test))
        return out.select("detector", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in [*M.METRICS, "roc_auc", "pr_auc"]])
    return run


for _name in ("text_logreg", "text_svm", "text_rf"):
    query(_name)(_baseline(_name))


@query("evaluate_baselines")
def evaluate_baselines(spark, sf):
    train, test = _text_split(spark, sf)
    real = holdout(spark, sf).select("id", "category", "label", "script")
    out = textml.evaluate_baselines(train, test, real)
    return out.select("target", "detector", *[r6(c).alias(c) for c in [*M.METRICS, "roc_auc", "pr_auc"]])


TEXT_DETECTORS = ("text_logreg", "text_svm")


@query("evasion_budget_text")
def evasion_budget_text(spark, sf):
    """The trained text detectors on every disguise and substitution of the dangerous test rows."""
    train, test = _text_split(spark, sf)
    rewrites = {**mutate.DISGUISES, **mutate.ATTACKS}
    return _recall_columns(textml.variant_recall(train, test, rewrites, TEXT_DETECTORS))


@query("external_fpr_text")
def external_fpr_text(spark, sf):
    """False positives of the trained text detectors on a benign corpus they have not seen."""
    train, _ = _text_split(spark, sf)
    pred = textml.baseline_predictions(TEXT_DETECTORS, train, benign(spark, sf).select("id", "label", "script"))
    return _fpr_columns(learning.flagged_share(pred, "detector"))


@query("squash_margin", Q.with_(SCORED) + f"SELECT id, {d6(Q.sigmoid('logit / 2'))} AS squashed FROM scored")
def squash_margin(spark, sf):
    return scored(spark, sf).select("id", r6(textml.squash_margin(F.col("logit") / 2)).alias("squashed"))


def _text_metrics(out, extra=()):
    return out.select("detector", *[r6(c).alias(c) for c in [*M.METRICS, "roc_auc", "pr_auc", *extra]])


@query("gbt_on_features")
def gbt_on_features(spark, sf):
    return _text_metrics(textml.gbt_on_features(*_text_split(spark, sf), rounds=300))


@query("union_features_tfidf")
def union_features_tfidf(spark, sf):
    return _text_metrics(textml.union_features_tfidf(*_text_split(spark, sf)))


@query("tuned_text_logreg")
def tuned_text_logreg(spark, sf):
    return _text_metrics(textml.tuned_text_logreg(*_text_split(spark, sf)), ["best_c"])


# -- §2.14 ----------------------------------------------------------------------
@query("stream_analyze", Q.with_(SCORED) + f"SELECT id, {d6('risk')} AS risk, level, dangerous, array_to_string(hit_ids, ',') AS hits FROM scored")
def stream_analyze(spark, sf):
    """The gate over a stream of scripts, run until the input is used up."""
    keys = spread(jobs.stream_table(spark, sf, "orders"), "o_orderkey")
    gated = jobs.stream_analyze(synthesize_corpus(keys, "o_orderkey").select("id", "script"))
    flat = gated.select("id", "risk", "level", "dangerous",
                        F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("hits"))
    return jobs.collect_stream(flat, "gate").withColumn("risk", r6("risk"))


@query("stream_decide", "WITH " + EVENTS_SQL + ", " + RULES_SQL + f" SELECT event_id, level, syscall, {DECIDED_COLUMNS} FROM decided")
def stream_decide(spark, sf):
    events = syscalls(jobs.stream_table(spark, sf, "events"))
    decided = jobs.stream_decide(events).select("event_id", "level", "syscall", "action", "reason")
    return jobs.collect_stream(decided, "decisions")


@query("stream_monitor", CHECKS["monitor_report"])
def stream_monitor(spark, sf):
    """The running counts after the stream has read all events, stopped and started again."""
    decided = jobs.stream_decide(syscalls(jobs.stream_table(spark, sf, "events")))
    path, progress = shared_path(spark, "monitor"), shared_path(spark, "monitor-progress")
    for _ in range(2):
        jobs.run_available(jobs.stream_monitor(decided, path), progress)
    return jobs.monitor_snapshot(spark, path, monitor.monitor_report(decided).schema)


@query("stream_decide_windows", "WITH " + EVENTS_SQL + ", " + RULES_SQL + f""", x AS (SELECT ts, level, {DECIDED_COLUMNS} FROM decided),
w AS (SELECT date_trunc('hour', ts) AS window_start, level, action, count(*) AS n FROM x GROUP BY ALL)
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, level, action, n FROM w
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_decide_windows(spark, sf):
    """Hourly decision counts of the windows the watermark has closed."""
    decided = jobs.stream_decide(syscalls(jobs.stream_table(spark, sf, "events")))
    closed = jobs.collect_stream(jobs.decision_windows(decided), "windows")
    return closed.select(F.unix_seconds("window_start").alias("window_start"), "level", "action", "n")


@query("stream_feedback", Q.with_(SCORED) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {d6(f'{K.DEFAULT_WEIGHTS[f]} - 0.3 * (avg((risk - label) * {f}) + 0.001 * {K.DEFAULT_WEIGHTS[f]})')} AS weight FROM scored"
    for f in K.FEATURES) + f" UNION ALL SELECT 'bias', {d6(f'{K.DEFAULT_BIAS} - 0.3 * avg(risk - label)')} FROM scored")
def stream_feedback(spark, sf):
    """One gradient step per micro-batch; the whole file is one batch here."""
    path = shared_path(spark, "models")
    keys = spread(jobs.stream_table(spark, sf, "orders"), "o_orderkey")
    rows = scoring.features_for(synthesize_corpus(keys, "o_orderkey").select("label", "script")).drop("script")
    jobs.run_available(jobs.stream_feedback(rows, path), shared_path(spark, "models-progress"))
    versions = jobs.model_versions(spark, path)
    newest = versions.groupBy("feature").agg(F.max_by("weight", "version").alias("weight"))
    return newest.filter("feature <> 'threshold'").withColumn("weight", r6("weight"))
