"""Queries of problem 1: spellings of one author."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.names import link_names
from folioflow.session import cut_lineage, table

TABLES = ("comment_marks", "change_spans", "folded_comments")


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select("author") for t in TABLES])


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the number of its name; spellings that stand alone are left out."""
    return link_names(authors(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cut_lineage(p1_groups(spark, sf_dir))
    return g.alias("x").join(g.alias("y"), "group").where("x.spelling < y.spelling").select(F.col("x.spelling").alias("author_a"), F.col("y.spelling").alias("author_b"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL: dict[str, str] = {}
