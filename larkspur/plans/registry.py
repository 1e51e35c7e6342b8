"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from larkspur.plans import audit_queries, fit_queries, guard_queries, metric_queries, model_queries, source_queries, split_queries

_MODULES = (split_queries, metric_queries, guard_queries, audit_queries, model_queries, fit_queries, source_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
