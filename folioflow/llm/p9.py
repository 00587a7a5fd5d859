"""Queries of problem 9: documents mixed to the target shares of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.mixing import mix, shares
from folioflow.llm.tokens import with_tokens
from folioflow.session import table


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"]), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest mixture in which every source meets its target."""
    mixed = mix(with_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"]), table(spark, sf_dir, "mix_targets"), "exact")
    return shares(mixed, table(spark, sf_dir, "mix_targets"))


def p9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source keeps its cap on repeats."""
    s = p9_shares(spark, sf_dir)
    return s.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("kept"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_exact_shares": p9_exact_shares, "p9_caps": p9_caps}
SQL = {"p9_caps": "SELECT source, true AS kept FROM mix_targets"}
