"""Queries of problem 10: particulars of persons in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.pii import Field, particulars, plain_sentences, redacted, train
from folioflow.llm.sampling import sample_documents
from folioflow.session import table

_trained: dict[int, Field] = {}


def field(spark: SparkSession, sf_dir: str) -> Field:
    """The field, trained once per process for the same plain sentences."""
    plain = plain_sentences(sample_documents(table(spark, sf_dir, "documents")))
    key = hash(tuple(plain))
    if key not in _trained:
        _trained.clear()
        _trained[key] = train(plain=plain)
    return _trained[key]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particulars(table(spark, sf_dir, "documents"), field(spark, sf_dir))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "documents"), field(spark, sf_dir))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
