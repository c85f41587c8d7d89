"""Lexical facts, context, signatures, scores, policies, event decisions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import context, fixed as K, lexical
from ..operators import policy, scoring, signatures
from . import sqlbase as Q
from .registry import (PARSED, SCORED, corpus, d6, parsed, query, r6, scored, table)

SCRIPTS = Q.scripts()


def _joined(column: str):
    return F.array_join(column, "\x01")


def _sql_joined(expr: str) -> str:
    return f"array_to_string({expr}, chr(1))"


# -- §2.2 lists --------------------------------------------------------------
for _name, _col in [("extract_urls", "urls"), ("extract_paths", "paths"),
                    ("extract_devices", "devices"), ("extract_commands", "commands"),
                    ("extract_flags", "flags"), ("tokenize", "words")]:
    def _list_query(spark, sf, col=_col):
        return parsed(spark, sf).select("id", F.size(col).alias("n"), _joined(col).alias(col))

    query(_name, Q.with_(PARSED) +
          f"SELECT id, len({_col})::INTEGER AS n, {_sql_joined(_col)} AS {_col} FROM parsed"
          )(_list_query)


@query("split_segments", Q.with_(SCRIPTS) + f"""
SELECT id, len(segs)::INTEGER AS n, {_sql_joined('segs')} AS segments
FROM (SELECT id, {Q.segments('script')} AS segs FROM scripts)""")
def split_segments(spark, sf):
    return parsed(spark, sf).select(
        "id", F.size("segments").alias("n"), _joined("segments").alias("segments"))


@query("basename", Q.with_(PARSED) + f"""
SELECT name, count(*) AS n FROM (
  SELECT {Q.basename('w')} AS name FROM (SELECT unnest(words) AS w FROM parsed))
GROUP BY name""")
def basename(spark, sf):
    words = parsed(spark, sf).select(F.explode("words").alias("w"))
    return words.groupBy(lexical.basename(F.col("w")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"))


# -- §2.2 counters: the generated scripts and the raw web pages ------------------
for _name, _fn, _sql in [
    ("line_count", lexical.line_count, Q.line_count),
    ("comment_lines", lexical.comment_lines, Q.comment_lines),
    ("command_substitutions", lexical.command_substitutions, Q.substitutions),
    ("heredocs", lexical.heredocs, Q.heredocs),
    ("pipe_count", lexical.pipe_count, Q.pipe_count),
    ("redirections", lexical.redirections, Q.redirections),
    ("background_jobs", lexical.background_jobs, Q.background_jobs),
]:
    def _count_query(spark, sf, fn=_fn, name=_name):
        ours = corpus(spark, sf).select("id", "script")
        pages = table(spark, sf, "pages").select(
            F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("id"),
            F.col("html").alias("script"))
        return ours.unionByName(pages).select("id", fn(F.col("script")).alias(name))

    query(_name, Q.with_(SCRIPTS, """texts AS (
  SELECT id, script FROM scripts UNION ALL SELECT 'page_' || page_id, html FROM pages)""") +
          f"SELECT id, {_sql('script')} AS {_name} FROM texts")(_count_query)


@query("pipes_to_shell", Q.with_(SCRIPTS) +
       f"SELECT id, {Q.pipes_to_shell('script')} AS pipes_to_shell FROM scripts")
def pipes_to_shell(spark, sf):
    return corpus(spark, sf).select(
        "id", lexical.pipes_to_shell(F.col("script")).alias("pipes_to_shell"))


_LISTS = ["commands", "flags", "words", "paths", "urls", "devices"]
_COUNTS = ["pipe_count", "command_substitutions", "redirections", "background_jobs",
           "heredocs", "line_count", "comment_lines"]


@query("parse_scripts", Q.with_(PARSED) + f"""
SELECT id, 'fallback' AS parsed_with, {', '.join(f"{_sql_joined(c)} AS {c}" for c in _LISTS)},
  pipes_to_shell, {', '.join(_COUNTS)} FROM parsed""")
def parse_scripts(spark, sf):
    p = lexical.as_parsed_struct(parsed(spark, sf))
    return p.select("id", "parsed.parsed_with",
                    *[_joined(F.col(f"parsed.{c}")).alias(c) for c in _LISTS],
                    "parsed.pipes_to_shell", *[f"parsed.{c}" for c in _COUNTS])


# -- §2.3 ----------------------------------------------------------------------
_DIMS = ["privilege_required", "network_egress", "filesystem_scope", "irreversibility",
         "obfuscation"]
CONTEXT = Q.with_(PARSED, Q.context())
for _dim in _DIMS:
    def _dim_query(spark, sf, dim=_dim):
        return context.extract_context(parsed(spark, sf)).select(
            "id", r6(f"context_{dim}").alias(dim))

    query(_dim, CONTEXT + f"SELECT id, {d6(f'context_{_dim}')} AS {_dim} FROM ctx")(_dim_query)


@query("extract_context", CONTEXT + "SELECT id, " + ", ".join(
    f"{d6(f'context_{d}')} AS {d}" for d in _DIMS) + " FROM ctx")
def extract_context(spark, sf):
    return context.extract_context(parsed(spark, sf)).select(
        "id", *[r6(f"context_{d}").alias(d) for d in _DIMS])


# -- §2.4 ----------------------------------------------------------------------
FLAGGED = Q.with_(SCRIPTS, Q.flags_cte("scripts"))


@query("match_signatures", FLAGGED + f"""
SELECT id, array_to_string({Q.hit_list()}, ',') AS hits FROM flagged""")
def match_signatures(spark, sf):
    hits = signatures.match_signatures(corpus(spark, sf))
    return hits.select("id", F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("hits"))


def _unpivot_hits() -> str:
    rows = ", ".join(f"({Q.lit(s[0])}, {Q.lit(s[1])}, {s[2]!r}::DOUBLE)" for s in K.SIGNATURES)
    return (f"hits AS (SELECT id, k.signature_id, k.category, k.weight FROM "
            f"(SELECT id, unnest({Q.hit_list()}) AS sid FROM flagged) f JOIN "
            f"(VALUES {rows}) k(signature_id, category, weight) ON k.signature_id = f.sid)")


@query("signature_hits", FLAGGED + ", " + _unpivot_hits() +
       " SELECT id, signature_id, category, weight FROM hits")
def signature_hits(spark, sf):
    return signatures.signature_hits(corpus(spark, sf))


@query("aggregate_weight", FLAGGED + ", " + _unpivot_hits() + """
SELECT s.id, coalesce(sum(h.weight), 0.0::DOUBLE) AS total_weight
FROM scripts s LEFT JOIN hits h ON h.id = s.id GROUP BY s.id""")
def aggregate_weight(spark, sf):
    return signatures.match_signatures(corpus(spark, sf)).select(
        "id", signatures.aggregate_weight(F.col("hits")).alias("total_weight"))


@query("category_breakdown", FLAGGED + ", " + _unpivot_hits() + """
SELECT id, category, sum(weight) AS weight FROM hits GROUP BY id, category""")
def category_breakdown(spark, sf):
    return signatures.category_breakdown(corpus(spark, sf))


@query("signature_usage", FLAGGED + ", " + _unpivot_hits() + ", kb(signature_id, category, weight) AS (VALUES " +
       ", ".join(f"({Q.lit(s[0])}, {Q.lit(s[1])}, {s[2]!r}::DOUBLE)" for s in K.SIGNATURES) + """)
SELECT kb.signature_id, kb.category, kb.weight, count(h.id) AS n_rows
FROM kb LEFT JOIN hits h ON h.signature_id = kb.signature_id GROUP BY ALL""")
def signature_usage(spark, sf):
    return signatures.signature_usage(corpus(spark, sf))


@query("signature_lint", FLAGGED + ", " + _unpivot_hits() + """,
kb AS (SELECT DISTINCT signature_id, category FROM hits WHERE category <> 'tampering')
SELECT h.signature_id AS id, 'unknown category' AS problem
FROM (SELECT signature_id FROM hits GROUP BY signature_id) h
WHERE h.signature_id NOT IN (SELECT signature_id FROM kb)""")
def signature_lint(spark, sf):
    """Lint of the signatures seen in the corpus against all categories but one."""
    kb = signatures.signature_table(spark)
    seen = signatures.signature_hits(corpus(spark, sf)).groupBy("signature_id").agg(
        F.count(F.lit(1)).alias("n"))
    used = kb.join(seen, kb["id"] == seen["signature_id"], "left_semi")
    return signatures.signature_lint(used, [c for c in signatures.CATEGORIES if c != "tampering"])


# -- §2.5 ----------------------------------------------------------------------
@query("build_features", Q.with_(SCORED) +
       "SELECT id, " + ", ".join(f"{d6(f)} AS {f}" for f in K.FEATURES) + " FROM scored")
def build_features(spark, sf):
    return scoring.build_features(corpus(spark, sf)).select("id", *[r6(f).alias(f) for f in K.FEATURES])


@query("features_for", Q.with_(SCORED) + "SELECT category, label, count(*) AS n, " + ", ".join(
    f"{d6(f'avg({f})')} AS mean_{f}" for f in K.FEATURES) + " FROM scored GROUP BY category, label")
def features_for(spark, sf):
    rows = scoring.features_for(corpus(spark, sf))
    return rows.groupBy("category", "label").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(f)).alias(f"mean_{f}") for f in K.FEATURES])


@query("score", Q.with_(SCORED) + f"""
SELECT id, {d6('logit')} AS logit, {d6('risk')} AS risk, {d6('trust')} AS trust, level, dangerous
FROM scored""")
def score(spark, sf):
    return scored(spark, sf).select("id", r6("logit").alias("logit"), r6("risk").alias("risk"),
                                    r6("trust").alias("trust"), "level", "dangerous")


@query("contributions", Q.with_(SCORED) + "SELECT id, feature, " + d6("contribution") +
       " AS contribution FROM (" + " UNION ALL ".join(
           f"SELECT id, '{f}' AS feature, {K.DEFAULT_WEIGHTS[f]!r}::DOUBLE * {f} AS contribution FROM scored"
           for f in K.FEATURES) + ")")
def contributions(spark, sf):
    return scoring.contributions(scored(spark, sf)).select(
        "id", "feature", r6("contribution").alias("contribution"))


@query("trust_level", Q.with_(SCORED) +
       "SELECT category, level, count(*) AS n FROM scored GROUP BY category, level")
def trust_level(spark, sf):
    return scored(spark, sf).groupBy("category", "level").agg(F.count(F.lit(1)).alias("n"))


@query("decide", Q.with_(SCORED) + """
SELECT label, risk >= 0.319 AS flagged, count(*) AS n FROM scored GROUP BY ALL""")
def decide(spark, sf):
    rows = scored(spark, sf).withColumn("flagged", scoring.decide(F.col("risk"), 0.319))
    return rows.groupBy("label", "flagged").agg(F.count(F.lit(1)).alias("n"))


@query("ablate", Q.with_(SCORED) + " UNION ALL ".join(
    f"SELECT id, '{name}' AS config, {d6(Q.sigmoid(Q.logit(off)))} AS risk FROM features"
    for name, off in K.ABLATIONS if off))
def ablate(spark, sf):
    parts = [scoring.ablate(corpus(spark, sf).select("id", "script"), off).select(
        "id", F.lit(name).alias("config"), r6("risk").alias("risk"))
        for name, off in K.ABLATIONS if off]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _posture_values() -> str:
    def val(v):
        return str(v).upper() if isinstance(v, bool) else (Q.lit(v) if isinstance(v, str) else f"{v}::INTEGER")
    return ", ".join("(" + ", ".join([Q.lit(lv)] + [val(v) for v in K.LEVEL_POSTURE[lv]]) + ")" for lv in K.LEVELS)


POLICY = ("policy(level, decision, network, new_privileges, read_only_rootfs, cpu_quota, "
          f"memory_limit, pids_limit) AS (VALUES {_posture_values()})")


@query("analyze", Q.with_(SCORED, POLICY) + f"""
SELECT s.id, s.category, s.label, {_sql_joined('commands')} AS commands,
  {', '.join(f"{d6(f)} AS {f}" for f in K.FEATURES)},
  array_to_string(hit_ids, ',') AS hits, {d6('logit')} AS logit, {d6('risk')} AS risk,
  {d6('trust')} AS trust, s.level, dangerous, p.decision, p.network, p.pids_limit
FROM scored s JOIN policy p ON p.level = s.level""")
def analyze(spark, sf):
    """Flagship: the whole analysis of every script as one narrow stage."""
    rows = scoring.analyze(corpus(spark, sf).select("id", "category", "label", "script"))
    return rows.select(
        "id", "category", "label", _joined("commands").alias("commands"),
        *[r6(f).alias(f) for f in K.FEATURES],
        F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("hits"),
        r6("logit").alias("logit"), r6("risk").alias("risk"), r6("trust").alias("trust"),
        "level", "dangerous", "decision", "network", "pids_limit")


@query("model_table", Q.with_(SCORED) + f"""
SELECT label, {d6('avg(r)')} AS mean_risk, count(*) FILTER (r >= 0.4) AS n_flagged FROM (
  SELECT label, {Q.sigmoid(Q.logit(weights={**K.DEFAULT_WEIGHTS, 'threat_weight_norm': 5.0}, bias=-3.0))} AS r
  FROM features) GROUP BY label""")
def model_table(spark, sf):
    """Score with a model read back from its table after a partial override."""
    override = spark.createDataFrame(
        [("threat_weight_norm", 5.0), ("bias", -3.0), ("threshold", 0.4)], "feature string, weight double")
    model = scoring.read_model(scoring.override_model(scoring.model_table(spark), override))
    rows = scoring.score(scoring.features_for(corpus(spark, sf)), model)
    return rows.groupBy("label").agg(r6(F.avg("risk")).alias("mean_risk"),
                                     F.count_if("dangerous").alias("n_flagged"))


# -- §2.6 ----------------------------------------------------------------------
@query("attach_policy", Q.with_(SCORED, POLICY) + """
SELECT s.id, p.* FROM scored s JOIN policy p ON p.level = s.level""")
def attach_policy(spark, sf):
    return policy.attach_policy(scored(spark, sf)).select(
        "id", "level", "decision", "network", "new_privileges", "read_only_rootfs", "cpu_quota",
        "memory_limit", "pids_limit")


@query("seccomp_profile", Q.with_(SCORED) + f"""
, base AS (SELECT unnest({Q.text_list(K.BASE_SYSCALLS)}) AS s),
extra(level, s) AS ({' UNION ALL '.join(
    f"SELECT '{lv}', unnest({Q.text_list(v)})" for lv, v in K.LEVEL_SYSCALLS.items() if v)}),
levels AS (SELECT unnest({Q.text_list(K.LEVELS)}) AS level),
allow AS (SELECT level, string_agg(s, ',' ORDER BY s) AS names FROM (
   SELECT level, s FROM levels, base UNION SELECT level, s FROM extra) GROUP BY level),
profile AS (SELECT level, CASE WHEN level = 'TRUSTED' THEN '{K.ACT_ALLOW}' ELSE '{K.ACT_ERRNO}' END AS default_action,
   '{K.ACT_ALLOW}:' || names
   || CASE WHEN level IN ('RESTRICT', 'DENY') THEN ';{K.ACT_ERRNO}:{','.join(K.NETWORK_DENIED_SYSCALLS)}' ELSE '' END
   || CASE WHEN level = 'DENY' THEN ';{K.ACT_KILL}:{','.join(K.KILLED_SYSCALLS)}' ELSE '' END AS rules FROM allow)
SELECT s.id, p.default_action, p.rules FROM scored s JOIN profile p ON p.level = s.level""")
def seccomp_profile(spark, sf):
    rows = policy.attach_policy(scored(spark, sf))
    text = F.transform("seccomp.syscalls", lambda r: F.concat(
        r["action"], F.lit(":"), F.array_join(r["names"], ",")))
    return rows.select("id", F.col("seccomp.defaultAction").alias("default_action"),
                       F.array_join(text, ";").alias("rules"))


REGO = """'package riskspark.execution' || chr(10) || chr(10) || '# Generated from the trust level.' || chr(10)
 || '# trust_level = ' || s.level || chr(10) || '# risk_score = ' || printf('%.4f', risk) || chr(10) || chr(10)
 || 'default allow = false' || chr(10) || chr(10) || 'trust_level := "' || s.level || '"' || chr(10)
 || 'risk_score := ' || printf('%.4f', risk) || chr(10) || 'matched_signatures := ['
 || array_to_string(list_transform(hit_ids, lambda h: '"' || h || '"'), ', ') || ']' || chr(10) || chr(10)
 || 'allow { trust_level == "' || s.level || '"; '
 || CASE WHEN decision IN ('allow', 'allow_with_audit') THEN 'true' ELSE 'false' END || ' }' || chr(10) || chr(10)
 || 'audit { ' || CASE WHEN decision IN ('allow_with_audit', 'sandbox') THEN 'true' ELSE 'false' END || ' }'
 || chr(10) || chr(10) || 'network_egress_allowed := ' || CASE WHEN network = 'allow' THEN 'true' ELSE 'false' END
 || chr(10) || 'allow_new_privileges := ' || CASE WHEN new_privileges THEN 'true' ELSE 'false' END || chr(10)"""


@query("rego_text", Q.with_(SCORED, POLICY) + f"""
SELECT id, {REGO} AS rego
FROM scored s JOIN policy p ON p.level = s.level""")
def rego_text(spark, sf):
    rows = scoring.analyze(corpus(spark, sf).select("id", "script"))
    return policy.with_rego(rows).select("id", "rego")


@query("namespace_constraints", Q.with_(SCORED, POLICY) + f"""
SELECT id, '{','.join(K.NAMESPACES)}' || CASE WHEN network = 'deny' THEN ',net' ELSE '' END AS namespaces,
  network, read_only_rootfs, NOT new_privileges AS no_new_privileges,
  cpu_quota || '/' || memory_limit || '/' || pids_limit AS cgroup,
  CASE WHEN s.level IN ('RESTRICT', 'DENY') THEN 'ALL' ELSE '{','.join(K.DROPPED_CAPABILITIES)}' END AS capabilities_drop
FROM scored s JOIN policy p ON p.level = s.level""")
def namespace_constraints(spark, sf):
    rows = policy.attach_policy(scored(spark, sf)).select("id", "namespace.*")
    return rows.select(
        "id", F.array_join("namespaces", ",").alias("namespaces"), "network", "read_only_rootfs",
        "no_new_privileges", F.concat_ws("/", "cgroup.cpu_quota", "cgroup.memory_limit",
                                         F.col("cgroup.pids_limit").cast("string")).alias("cgroup"),
        F.array_join("capabilities_drop", ",").alias("capabilities_drop"))


def _level_documents() -> str:
    """(level, seccomp, namespace): the parts of the JSON that depend on the level alone."""
    rows = []
    for lv in K.LEVELS:
        default, rules, namespaces, capabilities = K.LEVEL_SANDBOX[lv]
        _, network, privileges, read_only, cpu, memory, pids = K.LEVEL_POSTURE[lv]
        allowed = {"names": sorted({*K.BASE_SYSCALLS, *K.LEVEL_SYSCALLS[lv]}), "action": K.ACT_ALLOW}
        seccomp = {"defaultAction": default, "comment": K.PROFILE_COMMENT + lv, "architectures": K.ARCHITECTURES,
                   "syscalls": [allowed, *({"names": n, "action": a, "comment": c} for n, a, c in rules)]}
        namespace = {"namespaces": namespaces, "network": network, "read_only_rootfs": read_only,
                     "no_new_privileges": not privileges,
                     "cgroup": {"cpu_quota": cpu, "memory_limit": memory, "pids_limit": pids},
                     "capabilities_drop": capabilities}
        rows.append("(" + ", ".join(Q.lit(x) for x in (
            lv, *(json.dumps(d, separators=(",", ":")) for d in (seccomp, namespace)))) + ")")
    return ", ".join(rows)


@query("policy_json", Q.with_(SCORED, POLICY) + f""",
docs(level, seccomp, namespace) AS (VALUES {_level_documents()}),
texts AS (SELECT id, s.level, decision, {REGO} AS rego FROM scored s JOIN policy p ON p.level = s.level)
SELECT id, '{{"trust_level":"' || t.level || '","decision":"' || decision || '","seccomp_profile":' || seccomp
  || ',"rego_policy":' || to_json(rego)::VARCHAR || ',"namespace_constraints":' || namespace || '}}' AS policy
FROM texts t JOIN docs d ON d.level = t.level""")
def policy_json(spark, sf):
    rows = scoring.analyze(corpus(spark, sf).select("id", "script"))
    return policy.policy_json(policy.with_rego(rows))


@query("derive_denied_syscalls", Q.with_(PARSED) + f"""
SELECT id, {_sql_joined('list_sort(commands)')} AS commands, net AS needs_network, spawn AS needs_spawn,
  array_to_string(list_sort(list_concat(
    CASE WHEN net THEN []::VARCHAR[] ELSE {Q.text_list(K.DENY_WITHOUT_NETWORK)} END,
    CASE WHEN spawn THEN []::VARCHAR[] ELSE {Q.text_list(K.DENY_WITHOUT_SPAWN)} END,
    {Q.text_list(K.DENY_ALWAYS)})), ',') AS denied_syscalls
FROM (SELECT id, commands,
  {Q.has_any('commands', K.NETWORK_COMMANDS)} OR len(urls) > 0 OR pipes_to_shell AS net,
  {Q.has_any('commands', K.SPAWN_COMMANDS)} OR pipes_to_shell AS spawn FROM parsed)""")
def derive_denied_syscalls(spark, sf):
    return policy.derive_denied_syscalls(parsed(spark, sf)).select(
        "id", _joined(F.array_sort("commands")).alias("commands"), "needs_network", "needs_spawn",
        F.array_join("denied_syscalls", ",").alias("denied_syscalls"))
