"""Queries of problem 2: unsound answers of assessments and the kind of their defect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.language import Centroids, training_sentences
from folioflow.llm.pairs import defects, label_pairs
from folioflow.llm.sampling import sample_documents
from folioflow.session import table


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels over their cutoffs, with posteriors."""
    model = Centroids.train(training_sentences(sample_documents(table(spark, sf_dir, "documents"))))
    return defects(*label_pairs(table(spark, sf_dir, "assessments"), model))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_labels(spark, sf_dir).where("rank = 1").select("assess_id", "answer_field", "defect")


QUERIES = {"p2_found": p2_found, "p2_labels": p2_labels}
SQL: dict[str, str] = {}
