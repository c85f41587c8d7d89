"""Execution-context evidence: five doubles in [0, 1] per script.

Each is a capped sum of fixed increments.  Patterns run with ``(?d)`` so only
``\\n`` ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed as K
from .lexical import contains_any


def has_pattern(text: Column, pattern: str) -> Column:
    return contains_any(text, K.CONTEXT_NEEDS[pattern]) & text.rlike("(?d)" + pattern)


def has_command(commands: Column, names: list[str]) -> Column:
    return F.arrays_overlap(commands, F.array(*[F.lit(n) for n in names]))


def _capped(*evidence: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for condition, amount in evidence:
        total = total + F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total)


def privilege_required(text: Column, commands: Column) -> Column:
    return _capped((has_command(commands, K.PRIVILEGED_COMMANDS), 0.7),
                   (has_pattern(text, K.PRIVILEGE_PATTERN), 0.3))


def network_egress(text: Column, commands: Column, urls: Column, to_shell: Column) -> Column:
    return _capped((has_command(commands, K.NETWORK_COMMANDS), 0.5),
                   (F.size(urls) > 0, 0.3),
                   (to_shell, 0.2),
                   (has_pattern(text, K.DEV_NET_PATTERN), 0.4))


def filesystem_scope(text: Column, paths: Column, devices: Column) -> Column:
    def sensitive(p: Column) -> Column:
        return p.rlike("^(?:" + "|".join(K.SENSITIVE_ROOTS) + ")")

    return _capped((F.exists(F.concat(paths, devices), sensitive), 0.5),
                   (F.size(devices) > 0, 0.3),
                   (has_pattern(text, K.RECURSIVE_FLAG_PATTERN) & (F.size(paths) > 0), 0.2),
                   (has_pattern(text, K.BROAD_TARGET_PATTERN), 0.3))


def irreversibility(text: Column, commands: Column) -> Column:
    return _capped((has_command(commands, K.DESTRUCTIVE_COMMANDS), 0.5),
                   (has_pattern(text, K.RM_FLAG_PATTERN), 0.2),
                   (has_pattern(text, K.DEVICE_WRITE_PATTERN), 0.3),
                   (has_pattern(text, K.SHRED_PATTERN), 0.2))


def obfuscation(text: Column, substitutions: Column, lines: Column) -> Column:
    dense = (lines > 0) & (substitutions / F.greatest(F.lit(1), lines) > K.SUBSTITUTIONS_PER_LINE)
    return _capped((has_pattern(text, K.BASE64_PATTERN), 0.35),
                   (has_pattern(text, K.EVAL_PATTERN), 0.25),
                   (has_pattern(text, K.HEX_RUN_PATTERN), 0.25),
                   (has_pattern(text, K.PRINTF_OCTAL_PATTERN), 0.2),
                   (has_pattern(text, K.REVERSE_PATTERN), 0.1),
                   (dense, 0.15))


def extract_context(parsed: DataFrame, text: str = "script") -> DataFrame:
    """Add the five ``context_*`` columns to a frame from ``parse_scripts``."""
    t, c = F.col(text), F.col
    return parsed.withColumns({
        "context_privilege_required": privilege_required(t, c("commands")),
        "context_network_egress": network_egress(
            t, c("commands"), c("urls"), c("pipes_to_shell")),
        "context_filesystem_scope": filesystem_scope(t, c("paths"), c("devices")),
        "context_irreversibility": irreversibility(t, c("commands")),
        "context_obfuscation": obfuscation(t, c("command_substitutions"), c("line_count")),
    })
