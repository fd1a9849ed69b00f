"""The queries of the general operators."""

from __future__ import annotations

from braidwork.plans import annotations, assembly, graphs, oracles, problems, sequences, tools

MODULES = [problems, sequences, graphs, annotations, assembly, tools]


def all_queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()} | oracles.SQL
