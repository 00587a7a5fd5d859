"""Arriving versions compared with the ones before, as a stream of micro-batches.

``arriving`` is a streaming DataFrame of ``(path, version, text)``. Each batch is compared
with the newest version kept per path, written out, and becomes the kept one; late or
repeated versions (not newer than the kept one) are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.functions.text import split_lines
from folioflow.operators.diff import counts, diff_rows
from folioflow.session import cut_lineage


def compare_batch(batch: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(counts per path and version, the kept versions from now on)."""
    batch = batch.select("path", "version", "text").dropDuplicates(["path", "version"])
    if kept is None:
        kept = batch.limit(0)
    both = batch.withColumn("_new", F.lit(1)).unionByName(kept.select("path", "version", "text").withColumn("_new", F.lit(0)))
    order = W.partitionBy("path").orderBy("version", "_new")
    newest = F.max(F.when(F.col("_new") == 0, F.col("version"))).over(W.partitionBy("path"))
    seq = both.withColumn("_kept", newest).where("_new = 0 or _kept is null or version > _kept")
    seq = seq.withColumn("_before", F.lag("text").over(order))
    pairs = seq.where("_new = 1").select(F.concat_ws("@", "path", F.col("version").cast("string")).alias("pair_id"), split_lines(F.coalesce("_before", F.lit(""))).alias("old"), split_lines(F.coalesce("text", F.lit(""))).alias("new"))
    last = F.row_number().over(W.partitionBy("path").orderBy(F.desc("version"), F.desc("_new")))
    return counts(diff_rows(pairs)), seq.withColumn("_r", last).where("_r = 1").select("path", "version", "text")


BUCKETS = 256  # parts of the kept versions by path; a batch reads and writes only those it touches


def bucket(path: str = "path"):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def kept_versions(spark, state_folder: str, touched: list[int], number: int) -> DataFrame | None:
    """The newest kept versions of the touched buckets from before batch ``number``; None where no batch has been."""
    if number == 0:
        return None
    held = spark.read.option("basePath", state_folder).parquet(f"{state_folder}/batch=*").where((F.col("batch") < number) & F.col("bucket").isin(touched))
    newest = held.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # at most a row a bucket
    pairs = F.lit(False)
    for r in newest:
        pairs = pairs | ((F.col("bucket") == r["bucket"]) & (F.col("batch") == r["batch"]))
    return held.where(pairs).select("path", "version", "text")


def watch(arriving: DataFrame, state_folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the stream. The kept versions live as ``batch=N/bucket=B`` under ``state_folder``; a batch writes
    whole buckets anew, only those it touches, so a batch that is done again finds the same state. A
    state that can't be read stops the stream."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch.select("path", "version", "text"))
        touched = [r["b"] for r in batch.select(bucket().alias("b")).distinct().collect()]
        out, state = compare_batch(batch, kept_versions(spark, state_folder, touched, number))
        state.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_folder}/batch={number}")
        sink(out, number)

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
