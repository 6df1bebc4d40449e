"""Registration of queries beside their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql.strip()
            return f

        return keep
