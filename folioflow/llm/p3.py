"""Queries of problem 3: languages of blocks and of their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.encodings import label
from folioflow.llm.language import UNKNOWN, Centroids, language_segments, training_sentences
from folioflow.llm.p5 import clean_model
from folioflow.llm.sampling import sample_documents
from folioflow.session import table

LEAST_LETTERS = 40


def _segments(spark: SparkSession, sf_dir: str, blocks: DataFrame) -> DataFrame:
    model, clean = Centroids.train(training_sentences(sample_documents(table(spark, sf_dir, "documents")))), clean_model(spark, sf_dir)
    return language_segments(blocks, "block_id", model, lambda texts: [s is not None for s in label(clean, texts)])


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, table(spark, sf_dir, "blocks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the statement leaves blocks of fewer letters out, so they needn't be read for their language
    long = table(spark, sf_dir, "blocks").where(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= LEAST_LETTERS)
    # a part that no known language fits names none
    told = _segments(spark, sf_dir, long).where((F.col("n_letters") >= LEAST_LETTERS) & (F.col("lang") != UNKNOWN))
    per = told.groupBy("block_id").agg(F.first("marked").alias("marked"), F.collect_set("lang").alias("langs"))
    wrong = F.col("marked").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("marked"))
    return per.where(wrong).select("block_id", F.explode("langs").alias("lang"))


QUERIES = {"p3_found": p3_found, "p3_segments": p3_segments}
SQL: dict[str, str] = {}
