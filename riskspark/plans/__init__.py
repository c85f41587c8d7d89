"""Registered queries by theme."""

from __future__ import annotations

from . import metric_queries, registry, scoring_queries, study_queries  # noqa: F401


def all_queries() -> dict:
    return dict(registry.QUERIES)


def all_checks() -> dict[str, str]:
    return dict(registry.CHECKS)
