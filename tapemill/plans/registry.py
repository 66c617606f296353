"""Every query of the core with its SQL."""

from __future__ import annotations

from tapemill.plans import dataset_plans, explore_plans, index_plans, indicator_plans, problems, problems_sql, registry_plans

_MODULES = (indicator_plans, registry_plans, index_plans, dataset_plans, explore_plans)


def queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()} | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()} | problems_sql.SQL
