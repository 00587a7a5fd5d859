"""Queries of problem 5: records whose text was read in a wrong encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.encodings import CleanModel, clean_model as counted, find_garbled
from folioflow.session import table


def clean_model(spark: SparkSession, sf_dir: str) -> CleanModel:
    return counted(table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").select(F.lit("block").alias("record_kind"), F.col("block_id").alias("record_id"), "text")
    marks = table(spark, sf_dir, "comment_marks").select(F.lit("comment_mark").alias("record_kind"), F.col("mark_id").alias("record_id"), "text")
    return blocks.unionByName(marks)


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(texts(spark, sf_dir), clean_model(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_restored(spark, sf_dir).select("record_kind", "record_id")


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
SQL: dict[str, str] = {}
