"""Registered queries of the core, and the SQL they are held against."""

from weftline.queries import flows, general, learned, relational, text

MODULES = [general, relational.q, text.q, learned.q, flows.q]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
