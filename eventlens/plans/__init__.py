"""Registered queries over the given tables, and their DuckDB equivalents."""

from __future__ import annotations

from eventlens.plans import q_baseline, q_context, q_intelligence, q_log, q_models, q_outcomes, q_policy, q_streaming, q_validation
from eventlens.plans.canon import one_query

_MODULES = (q_log, q_validation, q_context, q_baseline, q_policy, q_outcomes, q_models, q_intelligence, q_streaming)


def queries() -> dict:
    """Query name -> callable (spark, sf_dir)."""
    return {k: one_query(f) for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, for those that SQL can express."""
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
