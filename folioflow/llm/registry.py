"""All queries of the subpackage, by name, with their SQL where there is one."""

from __future__ import annotations

from folioflow.llm import p1, p2, p3, p4, p5, p7, p8, p9, p10

MODULES = (p1, p2, p3, p4, p5, p7, p8, p9, p10)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
