"""Comparing two folders or snapshots: path join, renames, fingerprints.

A snapshot is ``(path, content)``. Contents meet only as SHA-256 digests, so they never
enter a shuffle; null contents count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.session import unsent


def digests(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("path", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias("sha"))


def compare_folders(old: DataFrame, new: DataFrame, common_only: bool = False, renames: bool = True) -> DataFrame:
    """``(change, old_path, new_path)`` of the files that differ: modified, added, deleted and,
    for equal contents under two names, renamed (the i-th old name with the i-th new one)."""
    o, n = digests(old).select(F.col("path").alias("old_path"), F.col("sha").alias("old_sha")), digests(new).select(F.col("path").alias("new_path"), F.col("sha").alias("new_sha"))
    if common_only:
        return o.join(unsent(n), F.col("old_path") == F.col("new_path")).where("old_sha <> new_sha").select(F.lit("modified").alias("change"), "old_path", "new_path")
    both = o.join(unsent(n), F.col("old_path") == F.col("new_path"), "full_outer")
    changed = both.where("old_sha is null or new_sha is null or old_sha <> new_sha")
    kind = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").otherwise("modified")
    out = changed.withColumn("change", kind)
    if not renames:
        return out.select("change", "old_path", "new_path")
    rank = lambda p, s: F.row_number().over(W.partitionBy(s).orderBy(p))
    gone = out.where("change = 'deleted'").select(F.col("old_path").alias("gone"), F.col("old_sha").alias("sha"), rank("old_path", "old_sha").alias("k"))
    came = out.where("change = 'added'").select(F.col("new_path").alias("came"), F.col("new_sha").alias("sha"), rank("new_path", "new_sha").alias("k"))
    moved = gone.join(unsent(came), ["sha", "k"]).select("gone", "came")
    kept = out.join(unsent(moved.select(F.col("gone").alias("g"))), F.col("old_path").eqNullSafe(F.col("g")) & (F.col("change") == "deleted"), "left_anti")
    kept = kept.join(unsent(moved.select(F.col("came").alias("c"))), F.col("new_path").eqNullSafe(F.col("c")) & (F.col("change") == "added"), "left_anti")
    return kept.select("change", "old_path", "new_path").union(moved.select(F.lit("renamed"), "gone", "came"))


def fingerprints_changed(saved: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose content is gone or no longer has the saved digest."""
    return digests(saved).join(digests(now), ["path", "sha"], "left_anti").select("path")
