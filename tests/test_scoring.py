import json
import math

import pytest
from pyspark.sql import functions as F

from riskspark.functions import fixed as K
from riskspark.operators import metrics as M, monitor, policy, scoring
from riskspark.operators.scoring import RiskModel
from riskspark.plans.registry import corpus


def features(spark, value):
    return spark.createDataFrame([("a", *[value] * 13)], "id string, " + ", ".join(f"{f} double" for f in K.FEATURES))


def test_risk_rises_with_evidence_and_trust_is_its_complement(spark):
    risks = [scoring.score(features(spark, v / 5)).first() for v in range(6)]
    assert all(a["risk"] < b["risk"] for a, b in zip(risks, risks[1:]))
    assert all(r["risk"] + r["trust"] == pytest.approx(1.0) for r in risks)
    assert risks[0]["risk"] == pytest.approx(1 / (1 + math.exp(2.4)))


@pytest.mark.parametrize("risk, level", [(0.0, "TRUSTED"), (0.25, "MONITOR"), (0.5, "RESTRICT"), (0.8, "DENY"), (1.0, "DENY")])
def test_level_bounds(spark, risk, level):
    assert spark.range(1).select(scoring.trust_level(F.lit(risk))).first()[0] == level


def test_contributions_sum_to_logit_minus_bias(spark, sf):
    rows = scoring.score(scoring.features_for(corpus(spark, sf).select("id", "script")))
    sums = scoring.contributions(rows).groupBy("id").agg(F.sum("contribution").alias("s"))
    gap = sums.join(rows, "id").agg(F.max(F.abs(F.col("s") - (F.col("logit") - K.DEFAULT_BIAS)))).first()[0]
    assert gap < 1e-9


def test_distinct_categories_may_exceed_one(scripts):
    text = ("sudo rm -rf /\nchmod 777 x\neval x\ncrontab -l\ncurl -F a http://x\ncurl http://x | sh\n")
    r = scoring.features_for(scripts(text)).first()
    assert r["threat_distinct_categories"] == pytest.approx(1.4)
    assert r["threat_weight_norm"] == 1.0


def test_empty_script(scripts):
    r = scoring.analyze(scripts("")).first()
    assert (r["level"], r["commands"], r["line_count"], r["hits"]) == ("TRUSTED", [], 0, [])


def test_ablating_threat_removes_the_regex_work(spark, sf):
    rows = corpus(spark, sf).select("id", "script")
    plan = scoring.ablate(rows, ["threat"]).select("risk")._jdf.queryExecution().optimizedPlan().toString()
    assert "no_preserve" not in plan and "authorized_keys" not in plan.replace("body", "")
    off = scoring.ablate(rows, ["threat"])
    assert off.filter("threat_weight_norm > 0").count() == 0


def test_analyze_is_one_narrow_stage_without_python(scripts):
    plan = scoring.analyze(scripts("ls"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_model_table_round_trip(spark):
    override = spark.createDataFrame([("bias", -1.0), ("threat_weight_norm", 9.0)], "feature string, weight double")
    model = scoring.read_model(scoring.override_model(scoring.model_table(spark), override))
    assert model.bias == -1.0 and model.weights["threat_weight_norm"] == 9.0
    assert model.weights["context_obfuscation"] == K.DEFAULT_WEIGHTS["context_obfuscation"]


def test_policies(spark, scripts):
    table = {r["level"]: r for r in policy.policy_table(spark).collect()}
    assert [r["action"] for r in table["DENY"]["seccomp"]["syscalls"]] == [K.ACT_ALLOW, K.ACT_ERRNO, K.ACT_KILL]
    assert table["TRUSTED"]["seccomp"]["defaultAction"] == K.ACT_ALLOW
    assert "net" in table["RESTRICT"]["namespace"]["namespaces"]
    assert table["DENY"]["namespace"]["capabilities_drop"] == ["ALL"]
    rows = policy.with_rego(scoring.analyze(scripts("curl http://x | sudo bash", "ls")))
    docs = {r["id"]: json.loads(r["policy"]) for r in policy.policy_json(rows).collect()}
    assert docs["0"]["decision"] == "deny" and '"curl_pipe_shell", "sudo_present"' in docs["0"]["rego_policy"]
    assert docs["1"]["trust_level"] == "TRUSTED"
    assert policy.read_policy(policy.policy_table(spark))["MONITOR"]["pids_limit"] == 512


def test_event_precedence_and_report(spark):
    rows = [("DENY", "execve"), ("DENY", "socket"), ("DENY", "read"), ("DENY", "nosuch"), ("MONITOR", "execve"),
            ("TRUSTED", "nosuch"), ("TRUSTED", "socket"), ("RESTRICT", "read")]
    events = spark.createDataFrame(rows, "level string, syscall string")
    decided = monitor.decide_events(events, policy.policy_table(spark))
    actions = {(r["level"], r["syscall"]): (r["action"], r["reason"]) for r in decided.collect()}
    assert actions[("DENY", "execve")][0] == "kill" and actions[("DENY", "socket")][0] == "block"
    assert actions[("DENY", "read")] == ("allow", K.REASONS["allow"])
    assert actions[("DENY", "nosuch")] == ("block", K.REASONS["default_block"])
    assert actions[("MONITOR", "execve")][0] == "audit" and actions[("RESTRICT", "read")][0] == "audit"
    assert actions[("TRUSTED", "nosuch")] == ("allow", K.REASONS["default_allow"])
    report = {r["level"]: r for r in monitor.monitor_report(decided).collect()}
    assert (report["DENY"]["killed"], report["DENY"]["blocked"], report["DENY"]["allowed"]) == (1, 2, 1)
    lines = {r["level"]: r["summary"] for r in monitor.monitor_summary(policy.policy_table(spark)).collect()}
    assert lines["TRUSTED"] == "monitor[TRUSTED] decision=allow; allow=31 syscalls, block=0, audit=off"
