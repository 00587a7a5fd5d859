"""Session helpers: table loading, shared checkpoint folder, salted joins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop) a fresh local
    folder is set; on a cluster that is an error, as other machines would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    folder = named or os.path.join(tempfile.gettempdir(), f"folioflow-{os.getpid()}")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that isn't sent whole to the driver and every worker. Spark takes what comes
    of exploded arrays, Python and checkpoints for far smaller than it is, and would broadcast it."""
    return df.hint("merge")


def salted_join(big: DataFrame, small: DataFrame, key: str, row_id: str, salts: int = 8, how: str = "left") -> DataFrame:
    """Equi-join where one key may hold a third of ``big``: its rows are spread over
    ``salts`` sub-keys and the narrow ``small`` side is replicated to each of them.

    Null keys meet nothing (rows stay under ``left``); they spread by salt as well.
    """
    b = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return b.join(s, [key, "_salt"], how).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, per name, the sum over the rows of the same key that come before.

    A key with a third of all rows isn't one task: rows are range-partitioned by key and
    order, summed within each partition, and the partitions' totals are added up in a small
    table. ``order`` must tell the rows of a key apart. Null is a key of its own.
    """
    d = cut_lineage(df.repartitionByRange(partitions(df.sparkSession), F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = d.groupBy(key, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = d.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    out = inside.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in sums}).select(*df.columns, *sums)
