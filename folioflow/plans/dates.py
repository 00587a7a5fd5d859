"""Queries of problem 6 (mixed timestamp formats and time zones)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions.timestamps import mask_column, normalise_dates
from folioflow.session import salted_join, table

DATED = (("comment_marks", "comment_mark", "mark_id"), ("change_spans", "span", "span_id"), ("comment_entries", "comment_entry", "entry_id"))


def dated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), "file_id", "date") for t, kind, key in DATED]
    return reduce(DataFrame.unionByName, parts)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "doc_files").select("file_id", "zone", "locale")
    records = dated_records(spark, sf_dir).where(F.length(F.trim("date")) > 0)
    return normalise_dates(salted_join(records, files, "file_id", "record_id"))


def p6_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records have each shape mask; null dates count under null."""
    return dated_records(spark, sf_dir).dropDuplicates(["record_kind", "record_id"]).groupBy(mask_column(F.col("date")).alias("mask")).agg(F.count("*").alias("n"))


def p6_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated records per UTC day and kind."""
    day = F.expr("cast(floor(utc_us / 86400000000) as bigint)")
    return p6_found(spark, sf_dir).groupBy("record_kind", day.alias("utc_day")).agg(F.count("*").alias("n"))


QUERIES = {"p6_found": p6_found, "p6_masks": p6_masks, "p6_days": p6_days}
SQL = {
    "p6_masks": r"""
WITH r AS (
  SELECT DISTINCT 'comment_mark' AS k, mark_id AS i, date FROM comment_marks
  UNION ALL SELECT DISTINCT 'span', span_id, date FROM change_spans
  UNION ALL SELECT DISTINCT 'comment_entry', entry_id, date FROM comment_entries)
SELECT regexp_replace(regexp_replace(trim(date), '\p{Nd}', '9', 'g'), '\p{L}+', 'A', 'g') AS mask, count(*) AS n
FROM r GROUP BY 1""",
}
