"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from occura.queries import analytics, evaluation, lineage, more, retrieval, rules, streams, telemetry, text

_REGISTRIES = tuple(m.register for m in (analytics, text, lineage, retrieval, telemetry, evaluation, streams, more, rules))


def queries() -> dict[str, Callable]:
    return {name: f for r in _REGISTRIES for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _REGISTRIES for name, sql in r.oracles.items()}
