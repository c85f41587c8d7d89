"""Decisions over observed syscalls, from the rules of a policy table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed as K

# kill beats block beats allow
PRECEDENCE = [(K.ACT_KILL, 3), (K.ACT_ERRNO, 2), (K.ACT_ALLOW, 1)]


def policy_rules(policy: DataFrame) -> DataFrame:
    """(level, syscall, action) rows of every seccomp rule."""
    rules = policy.select("level", F.explode("seccomp.syscalls").alias("r"))
    action = F.when(F.col("r.action") == K.ACT_KILL, "kill").when(
        F.col("r.action") == K.ACT_ERRNO, "block").otherwise("allow")
    return rules.select("level", F.explode("r.names").alias("syscall"), action.alias("action"))


def policy_defaults(policy: DataFrame) -> DataFrame:
    """(level, decision, default_block, auditing) per level."""
    return policy.select(
        "level", "decision", (F.col("seccomp.defaultAction") == K.ACT_ERRNO).alias("default_block"),
        F.col("decision").isin(K.AUDITING_DECISIONS).alias("auditing"))


def _strongest(rules: DataFrame) -> DataFrame:
    rank = F.when(F.col("action") == "kill", 3).when(F.col("action") == "block", 2).otherwise(1)
    return rules.groupBy("level", "syscall").agg(F.max(rank).alias("_rank"))


def decide_events(events: DataFrame, policy: DataFrame) -> DataFrame:
    """Add ``action`` and ``reason`` to events that carry level and syscall.

    Rules and defaults hold four levels and a fixed syscall list: broadcasts.
    """
    joined = events.join(F.broadcast(_strongest(policy_rules(policy))), ["level", "syscall"], "left")
    joined = joined.join(F.broadcast(policy_defaults(policy)), "level", "left")
    rank, audit = F.col("_rank"), F.col("auditing")
    kind = (F.when(rank == 3, "kill").when(rank == 2, "block")
            .when((rank == 1) & audit, "audit").when(rank == 1, "allow")
            .when(F.col("default_block"), "default_block").otherwise("default_allow"))
    reason = F.lit(None).cast("string")
    for name, text in K.REASONS.items():
        reason = F.when(F.col("_kind") == name, text).otherwise(reason)
    decided = joined.withColumn("_kind", kind)
    return decided.withColumns({
        "action": F.regexp_replace("_kind", "^default_", ""), "reason": reason,
    }).drop("_rank", "_kind", "default_block", "auditing")


def monitor_report(decided: DataFrame, keys: list[str] = ["level", "decision"]) -> DataFrame:
    a = F.col("action")
    return decided.groupBy(*keys).agg(
        F.count_if(a == "allow").alias("allowed"), F.count_if(a == "audit").alias("audited"),
        F.count_if(a == "block").alias("blocked"), F.count_if(a == "kill").alias("killed"))


def monitor_summary(policy: DataFrame) -> DataFrame:
    """Allow and block list sizes and the audit switch per level, with a text line."""
    sizes = policy_rules(policy).groupBy("level").agg(
        F.count_if(F.col("action") == "allow").alias("n_allow"),
        F.count_if(F.col("action") == "block").alias("n_block"),
        F.count_if(F.col("action") == "kill").alias("n_kill"))
    rows = sizes.join(policy_defaults(policy), "level")
    audit = F.when(F.col("auditing"), "on").otherwise("off")
    return rows.select(
        "level", "decision", "n_allow", "n_block", "n_kill", audit.alias("audit"),
        F.format_string("monitor[%s] decision=%s; allow=%d syscalls, block=%d, audit=%s",
                        "level", "decision", "n_allow", "n_block", audit).alias("summary"))
