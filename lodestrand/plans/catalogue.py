"""Registered queries of the evidence engine and their DuckDB counterparts."""

from __future__ import annotations

from . import corpus, knowledge, records, retrieval, scoring

MODULES = (corpus, retrieval, knowledge, scoring, records)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
