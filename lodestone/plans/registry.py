"""Collects the queries and SQL twins of the plan modules."""

from __future__ import annotations

from lodestone.plans import answers, dialogue, exchange, ingest, retrieval, scalars

MODULES = [retrieval, dialogue, scalars, ingest, answers, exchange]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
