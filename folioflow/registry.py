"""All queries of the core, by name, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans import dates, documents, extras, marks, prose, review, revisions, versions

FLAGSHIP = "aligned_counts"
MODULES = (dates, prose, revisions, review, versions, marks, documents, extras)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
