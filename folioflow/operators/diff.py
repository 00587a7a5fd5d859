"""Comparing versions at scale: one row per pair of files goes through the kernels.

``pairs(pair_id, old array<string>, new array<string>)`` are spread evenly by one shuffle
on the pair and handled in Arrow batches; no step crosses pairs, and everything after the
rows (counts, folding, hunks, reports) is native again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.config import Options
from folioflow.functions.text import split_lines
from folioflow.kernels.moves import compare
from folioflow.kernels.words import word_line, word_ops
from folioflow.session import partitions

ROW_FIELDS = "row_no bigint, kind string, left_no bigint, right_no bigint, old_line string, new_line string, changes array<string>, words_added bigint, words_removed bigint, move_pair bigint, edited boolean, moved_out array<string>, moved_in array<string>, words_added_plain bigint, words_removed_plain bigint"


def text_pairs(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of the texts under one key; a missing side has no lines."""
    o = old.select(F.col(key).alias("pair_id"), split_lines(F.col(text)).alias("old"))
    n = new.select(F.col(key).alias("pair_id"), split_lines(F.col(text)).alias("new"))
    empty = F.expr("cast(array() as array<string>)")
    return o.join(n, "pair_id", "full_outer").select("pair_id", F.coalesce("old", empty).alias("old"), F.coalesce("new", empty).alias("new"))


def diff_rows(pairs: DataFrame, options: Options | None = None) -> DataFrame:
    """``pair_id`` and the rows of the side-by-side table. Pairs with equal sides have no rows."""
    options = options or Options()
    kind = pairs.schema["pair_id"].dataType.simpleString()
    moves, settings = options.moves, options.passages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pair, old, new in zip(b["pair_id"], b["old"], b["new"], strict=True):
                old, new = list(old), list(new)
                compared = compare(old, new, moves, settings, options.move_passages, options.ignore_whitespace)
                for n, r in enumerate(compared):
                    plain = r.plain or (r.words_added, r.words_removed)
                    left, right = None if r.i is None else old[r.i], None if r.j is None else new[r.j]
                    rows.append((
                        pair, n + 1, r.kind, None if r.i is None else r.i + 1, None if r.j is None else r.j + 1, left, right, r.changes, r.words_added, r.words_removed, r.move, r.edited,
                        [left[s:e] for s, e, _ in r.out_spans], [right[s:e] for s, e, _ in r.in_spans], *plain,
                    ))
            out = pd.DataFrame(rows, columns=["pair_id", *(x.split()[0] for x in ROW_FIELDS.split(", "))])
            for c in ("left_no", "right_no", "move_pair"):
                out[c] = out[c].astype("Int64")
            yield out

    changed = pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select("pair_id", "old", "new")
    # a number of tasks of its own and by a hash no join shares: the bytes are few for the work, and small partitions would be joined to one
    changed = changed.repartition(partitions(pairs.sparkSession), F.xxhash64("pair_id"))
    return changed.mapInPandas(run, f"pair_id {kind}, {ROW_FIELDS}")


def _nine(passages: bool) -> list[Column]:
    kind = F.col("kind")
    n = lambda *ks: F.count(F.when(kind.isin(*ks), 1))
    a, r = ("words_added", "words_removed") if passages else ("words_added_plain", "words_removed_plain")
    moved = F.size("moved_out") if passages else F.lit(0)
    return [
        n("insert", "replace").alias("additions"), n("delete", "replace").alias("deletions"), F.sum(a).alias("words_added"), F.sum(r).alias("words_removed"), n("moved-out").alias("moved_lines"),
        F.sum(moved).cast("bigint").alias("moved_passages"), n("replace").alias("edited_lines"), n("insert").alias("inserted_lines"), n("delete").alias("deleted_lines"),
    ]


def counts(rows: DataFrame, *by: str | Column, passages: bool = True) -> DataFrame:
    """The nine counts, per pair by default; with ``passages`` off, as if no passage had moved."""
    return rows.groupBy(*(by or ("pair_id",))).agg(*_nine(passages))


def counts_with_subtotals(rows: DataFrame, *by: str, passages: bool = True) -> DataFrame:
    """The nine counts per ``by`` with the subtotals of each level and the total."""
    return rows.rollup(*by).agg(*_nine(passages))


def change_counts(rows: DataFrame) -> DataFrame:
    """``pair_id, changes, formatted``: rows that changed at all, and those that only changed in their formats."""
    only = F.size("formats") > 0 if "formats" in rows.columns else F.lit(False)
    return rows.groupBy("pair_id").agg(F.count(F.when(F.col("kind") != "equal", 1)).alias("changes"), F.count(F.when((F.col("kind") == "equal") & only, 1)).alias("formatted"))


def folded(rows: DataFrame, context: int = 0, max_hidden: int = 500) -> DataFrame:
    """Rows with ``shown``: changes and ``context`` rows around them; a long gap is left out whole."""
    order = W.partitionBy("pair_id").orderBy("row_no")
    r = rows.withColumn("_c", (F.col("kind") != "equal").cast("int")).withColumn("_g", F.sum("_c").over(order)).withColumn("_l", F.max("_g").over(W.partitionBy("pair_id")))
    inside = W.partitionBy("pair_id", "_g", "_c")
    r = r.withColumn("_u", F.row_number().over(inside.orderBy("row_no"))).withColumn("_d", F.row_number().over(inside.orderBy(F.desc("row_no")))).withColumn("_n", F.count("*").over(inside))
    shown = (F.col("_c") == 1) | ((F.col("_g") > 0) & (F.col("_u") <= context)) | ((F.col("_g") < F.col("_l")) & (F.col("_d") <= context))
    return r.withColumn("shown", shown).withColumn("omitted", ~shown & (F.col("_n") > max_hidden)).drop("_c", "_g", "_l", "_u", "_d", "_n")


def skips(rows: DataFrame) -> DataFrame:
    """The gaps between shown rows of ``folded`` rows: ``pair_id, after, hidden, omitted``; ``after``
    is the number of the last row before the gap, ``omitted`` whether it is left out whole."""
    order = W.partitionBy("pair_id").orderBy("row_no")
    h = rows.where(~F.col("shown")).withColumn("_n", F.col("row_no") - F.row_number().over(order))
    return h.groupBy("pair_id", "_n").agg((F.min("row_no") - 1).alias("after"), F.count("*").alias("hidden"), F.max("omitted").alias("omitted")).drop("_n")


def stops(rows: DataFrame, prose: bool = True) -> DataFrame:
    """``folded`` rows with ``stop``: where a reader going from change to change halts. In prose that
    is every change, in code the first of each run; a gap that isn't shown ends a run."""
    changed = F.col("shown") & (F.col("kind") != "equal")
    before = F.lag(changed, 1, False).over(W.partitionBy("pair_id").orderBy("row_no"))
    return rows.withColumn("stop", changed if prose else changed & ~before)


def word_changes(rows: DataFrame) -> DataFrame:
    """Word-level ops of the edited rows: ``pair_id, row_no, op, tag, o1, o2, n1, n2``."""
    kind = rows.schema["pair_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [(p, r, k, *op) for p, r, o, n in zip(b["pair_id"], b["row_no"], b["old_line"], b["new_line"], strict=True) for k, op in enumerate(word_ops(o, n))]
            yield pd.DataFrame(out, columns=["pair_id", "row_no", "op", "tag", "o1", "o2", "n1", "n2"])

    return rows.where("kind = 'replace'").select("pair_id", "row_no", "old_line", "new_line").mapInPandas(run, f"pair_id {kind}, row_no bigint, op bigint, tag string, o1 bigint, o2 bigint, n1 bigint, n2 bigint")


def word_lines(rows: DataFrame) -> DataFrame:
    """Each row as one line with ``[-removed-]`` and ``{+added+}``."""

    @F.pandas_udf("string")
    def mark(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([word_line(o or "", n or "") for o, n in zip(old, new, strict=True)])

    same = F.col("kind") == "equal"
    return rows.where(same).select("pair_id", "row_no", F.col("new_line").alias("text")).union(rows.where(~same).select("pair_id", "row_no", mark("old_line", "new_line").alias("text")))
