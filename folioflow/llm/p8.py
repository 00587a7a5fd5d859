"""Queries of problem 8: documents laid into containers of each capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.packing import pack
from folioflow.llm.tokens import with_tokens
from folioflow.session import cut_lineage, table


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = with_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return pack(items, table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, pieces and the share of the space that is used, per capacity."""
    packed = p8_packed(spark, sf_dir)
    per = packed.groupBy("pack_id", "shard", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"))
    caps = table(spark, sf_dir, "pack_sizes").select("pack_id", "label", "capacity")
    return (
        per.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).join(caps, "pack_id")
        .select("pack_id", "label", "capacity", "containers", "pieces", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
    )


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document lies in the containers whole: its pieces follow on each other,
    and only one that exceeds the capacity has several."""
    caps = table(spark, sf_dir, "pack_sizes").select("pack_id", F.col("capacity").cast("bigint").alias("capacity"))
    p = p8_packed(spark, sf_dir).join(caps, "pack_id")
    g = p.groupBy("pack_id", "doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("tokens").alias("most"), F.max("capacity").alias("c"))
    whole = (F.col("n") == F.col("last") + 1) & (F.col("t") == F.col("end")) & (F.col("most") <= F.col("c")) & ((F.col("n") == 1) | (F.col("t") > F.col("c")))
    return g.select("pack_id", "doc_id", whole.alias("whole"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the containers are from the target proportions: half the sum of absolute differences
    of their sources' shares from the targets, on average, at the median and over whole shards."""
    per = cut_lineage(p8_packed(spark, sf_dir).groupBy("pack_id", "shard", "container", "source").agg(F.sum("tokens").alias("t")))
    total = per.groupBy("pack_id").agg(F.sum("t").alias("all"))
    target = per.groupBy("pack_id", "source").agg(F.sum("t").alias("of")).join(total, "pack_id").select(F.col("pack_id").alias("p"), F.col("source").alias("s"), (F.col("of") / F.col("all")).alias("w"))

    def distance(level: list[str]) -> DataFrame:
        g = per.groupBy("pack_id", *level, "source").agg(F.sum("t").alias("t"))
        g = g.join(g.groupBy("pack_id", *level).agg(F.sum("t").alias("sum")), ["pack_id", *level]).where("sum > 0")
        g = g.join(target, (F.col("pack_id") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
        return g.groupBy("pack_id", *level).agg((0.5 * (F.sum(F.abs(F.col("t") / F.col("sum") - F.col("w"))) + 1 - F.sum("w"))).alias("d"))

    one = distance(["shard", "container"]).groupBy("pack_id").agg(F.count("*").alias("containers"), F.round(F.avg("d"), 6).alias("mean_deviation"), F.round(F.expr("percentile_approx(d, 0.5, 10000)"), 6).alias("median_deviation"))
    return one.join(distance(["shard"]).groupBy("pack_id").agg(F.round(F.max("d"), 6).alias("shard_deviation")), "pack_id")


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill, "p8_whole": p8_whole, "p8_mixture": p8_mixture}
SQL = {"p8_whole": "SELECT pack_id, doc_id, true AS whole FROM documents, pack_sizes"}
