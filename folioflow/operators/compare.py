"""Two folders, snapshots or revisions compared end to end: files paired, read, aligned, counted.

``(path, content)`` of either side → pairs by path and by equal content under another name →
one Arrow row per pair through the kernels → rows, panel entries and files as tables. Contents
are shuffled only for files that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.config import Options
from folioflow.functions.text import split_lines
from folioflow.kernels.comparison import Side, compare_sides, panel_of_sides, read_side
from folioflow.operators.folders import compare_folders
from folioflow.session import partitions, unsent

ROW = "row_no bigint, kind string, left_no bigint, right_no bigint, left_label string, right_label string, old_line string, new_line string, changes array<string>, words_added bigint, words_removed bigint, move_pair bigint, edited boolean, moved_out array<string>, moved_in array<string>, words_added_plain bigint, words_removed_plain bigint, formats array<string>, language string"
ENTRY = "author string, text string, status string, label string, anchor string, date string"
PAIR = "pair_id string, change string, old_path string, new_path string"
AT_ONCE = 200  # pairs whose results are held before they are handed on


def file_pairs(old: DataFrame, new: DataFrame, common_only: bool = False, renames: bool = True) -> DataFrame:
    """``pair_id, change, old_path, new_path, old, new`` of the files that differ; ``pair_id`` is the new path, or the old one of a deleted file."""
    pairs = compare_folders(old, new, common_only, renames)
    pairs = pairs.join(unsent(old.select(F.col("path").alias("old_path"), F.col("content").alias("old"))), "old_path", "left")
    pairs = pairs.join(unsent(new.select(F.col("path").alias("new_path"), F.col("content").alias("new"))), "new_path", "left")
    return pairs.select(F.coalesce("new_path", "old_path").alias("pair_id"), "change", "old_path", "new_path", F.col("old").cast("binary").alias("old"), F.col("new").cast("binary").alias("new"))


def compared(pairs: DataFrame, options: Options | None = None, panel_only: bool = False) -> DataFrame:
    """``pair_id, change, old_path, new_path, error, read_as, rows, panel`` of ``file_pairs``; a file
    that can't be read has an ``error`` and no rows. With ``panel_only`` no lines are aligned and there are no rows."""
    options = options or Options()
    schema = f"{PAIR}, error string, read_as string, rows array<struct<{_struct(ROW)}>>, panel array<struct<{_struct(ENTRY)}>>"
    run = lambda batches: compared_frames(batches, options, panel_only)
    return pairs.repartition(partitions(pairs.sparkSession), F.xxhash64("pair_id")).mapInPandas(run, schema)


def compared_frames(batches: Iterator[pd.DataFrame], options: Options, panel_only: bool = False) -> Iterator[pd.DataFrame]:
    """Frames of ``compared``, of ``AT_ONCE`` pairs at most: a batch of thousands of files has rows for a gigabyte."""
    columns = [*(x.split()[0] for x in PAIR.split(", ")), "error", "read_as", "rows", "panel"]
    for b in batches:
        for at in range(0, len(b), AT_ONCE):
            out = []
            for r in b.iloc[at : at + AT_ONCE].itertuples(index=False):
                rows, panel, error, read_as = [], [], None, None
                try:
                    old, new = (read_side(p, None if d is None else bytes(d), options) if isinstance(p, str) else Side() for p, d in ((r.old_path, r.old), (r.new_path, r.new)))
                    read_as = new.read_as or old.read_as
                    rows, panel = ([], panel_of_sides(old, new)) if panel_only else compare_sides(old, new, options)
                except Exception as e:  # one bad file must not fail the job
                    error = str(e) or type(e).__name__
                out.append((r.pair_id, r.change, r.old_path, r.new_path, error, read_as, rows, panel))
            yield pd.DataFrame(out, columns=columns)


def _struct(fields: str) -> str:
    return ", ".join(": ".join(x.split(" ", 1)) for x in fields.split(", "))


def rows_of(done: DataFrame) -> DataFrame:
    """The rows of ``compared`` pairs, one a line, as ``diff.counts``, ``diff.folded`` and the sinks take them."""
    return done.select("pair_id", F.explode("rows").alias("r")).select("pair_id", "r.*")


def panel_of(done: DataFrame) -> DataFrame:
    """The comment panel of ``compared`` pairs: ``pair_id, author, text, status, label, anchor, date``."""
    return done.select("pair_id", F.explode("panel").alias("p")).select("pair_id", "p.*")


def review_edits(texts: DataFrame, key: str, text: str, edit: Column) -> DataFrame:
    """Pairs of each text with itself after ``edit``: ``pair_id, old, new`` for ``diff.diff_rows``."""
    return texts.select(F.col(key).alias("pair_id"), split_lines(F.col(text)).alias("old"), split_lines(edit).alias("new"))


def single_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One text alone: each line an equal row of the new side."""
    lines = texts.select(F.col(key).alias("pair_id"), F.posexplode(split_lines(F.col(text))).alias("n", "new_line"))
    no = (F.col("n") + 1).cast("bigint")
    return lines.select("pair_id", no.alias("row_no"), F.lit("equal").alias("kind"), F.lit(None).cast("bigint").alias("left_no"), no.alias("right_no"), F.lit(None).cast("string").alias("old_line"), "new_line")


def snapshot(versions: DataFrame, revision: str) -> DataFrame:
    """``(path, content)`` of one revision of a table ``(revision, path, content)``."""
    return versions.where(F.col("revision") == revision).select("path", "content")


def compare_revisions(versions: DataFrame, base: str, target: str, options: Options | None = None) -> DataFrame:
    """``compared`` files between two revisions of a table ``(revision, path, content)``."""
    return compared(file_pairs(snapshot(versions, base), snapshot(versions, target)), options)


def read_git(spark: SparkSession, repository: str, revision: str = "HEAD") -> DataFrame:
    """``(path, content)`` of a commit, or of the index for ``INDEX``. The names are listed on the driver,
    the contents read where the rows are, so the repository lies in a folder that all executors see."""
    import subprocess

    listing = ["ls-files", "-s", "-z"] if revision == "INDEX" else ["ls-tree", "-r", "-z", "--full-tree", revision]
    done = subprocess.run(["git", "-C", repository, *listing], capture_output=True, check=True, timeout=600)
    entries = []
    for x in filter(None, done.stdout.decode("utf-8", "surrogateescape").split("\0")):
        head, _, path = x.partition("\t")
        mode, *rest = head.split()
        if mode.startswith("100"):  # files, no links and no submodules
            entries.append((path, rest[0] if revision == "INDEX" else rest[1]))

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            asked = "".join(f"{x}\n" for x in b["blob"]).encode()
            data = subprocess.run(["git", "-C", repository, "cat-file", "--batch"], input=asked, capture_output=True, check=True, timeout=600).stdout
            out, at = [], 0
            for path in b["path"]:
                end = data.index(b"\n", at)
                size = int(data[at:end].split()[2])
                out.append((path, data[end + 1 : end + 1 + size]))
                at = end + 2 + size
            yield pd.DataFrame(out, columns=["path", "content"])

    files = spark.createDataFrame(entries, "path string, blob string")
    return files.repartition("path").mapInPandas(contents, "path string, content binary")
