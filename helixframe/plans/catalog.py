"""The named queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from helixframe.plans import contact_rules, metrics, relational, spatial, structures

_ALL = spatial.QUERIES | metrics.QUERIES | structures.QUERIES | contact_rules.QUERIES | relational.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
