"""Queries of problem 4: the sentences of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.encodings import label
from folioflow.llm.p5 import clean_model
from folioflow.llm.sentences import split_sentences
from folioflow.session import table

KINDS = ("p", "item", "note")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = clean_model(spark, sf_dir)
    blocks = table(spark, sf_dir, "blocks").where(F.col("kind").isin(*KINDS)).select("block_id", "text")
    return split_sentences(blocks, "block_id", lambda texts: [s is not None for s in label(model, texts)])


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences per block."""
    return p4_found(spark, sf_dir).groupBy("block_id").agg(F.count("*").alias("sentences"))


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
SQL: dict[str, str] = {}
