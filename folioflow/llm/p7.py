"""Queries of problem 7: percentiles of assess_history.seconds per ai, effort and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.quantiles import build_sketches, merge_sketches, read_quantiles
from folioflow.session import table

KEYS = ("ai", "effort", "kind")
AT = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def runs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Each run once; repeats carry the same fields."""
    return table(spark, sf_dir, "assess_history").select("run_id", *KEYS, "seconds", *more).dropDuplicates(["run_id"])


def p7_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_quantiles(build_sketches(runs(spark, sf_dir), KEYS, "seconds"), KEYS, AT)


def p7_from_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of separate years, then combined without the rows."""
    d = runs(spark, sf_dir, "date").withColumn("year", F.substring("date", 1, 4))
    yearly = build_sketches(d, ("year", *KEYS), "seconds")
    return read_quantiles(merge_sketches(yearly, KEYS), KEYS, AT)


def p7_bound_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact check of the stated error: for each group and percentile, the true ranks of
    the reported value against the wanted rank."""
    q = p7_quantiles(spark, sf_dir).select(*KEYS, F.col("n"), "rank_error", F.explode(F.create_map(*[x for k, v in AT.items() for x in (F.lit(v), F.col(k))])).alias("q", "v"))
    values = runs(spark, sf_dir).where(F.col("seconds").isNotNull() & ~F.isnan("seconds"))
    asked = q.groupBy(*KEYS, "n", "rank_error").agg(F.collect_list(F.struct("q", "v")).alias("asked"))  # six per group
    same = [values[k].eqNullSafe(asked[k]) for k in KEYS]
    each = values.join(asked, same, "inner").select(*[values[k] for k in KEYS], "n", "rank_error", "seconds", F.explode("asked").alias("a"))
    ranks = each.groupBy(*KEYS, "n", "rank_error", F.col("a.q").alias("q")).agg(
        F.sum((F.col("seconds") < F.col("a.v")).cast("bigint")).alias("below"), F.sum((F.col("seconds") <= F.col("a.v")).cast("bigint")).alias("upto")
    )
    wanted = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    ok = (wanted >= F.col("below") + 1 - F.col("rank_error")) & (wanted <= F.col("upto") + F.col("rank_error"))
    return ranks.groupBy(*KEYS, "n").agg(F.min(ok).alias("within_bound"))


QUERIES = {"p7_quantiles": p7_quantiles, "p7_from_years": p7_from_years, "p7_bound_holds": p7_bound_holds}
SQL = {
    "p7_bound_holds": """
SELECT ai, effort, kind, count(*) AS n, true AS within_bound
FROM (SELECT DISTINCT run_id, ai, effort, kind, seconds FROM assess_history)
WHERE seconds IS NOT NULL AND NOT isnan(seconds) GROUP BY ai, effort, kind""",
}
