"""Collecting queries and the SQL they are held against."""

from __future__ import annotations


class Queries:
    def __init__(self) -> None:
        self.QUERIES: dict = {}
        self.ORACLES: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLES[f.__name__] = sql.strip()
            return f

        return add
