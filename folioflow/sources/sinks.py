"""Outputs of a comparison: unified diffs, word diffs, HTML, the new version, tables."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.functions.text import escape_html
from folioflow.operators.diff import skips


def hunks(rows: DataFrame, context: int = 3) -> DataFrame:
    """``(pair_id, hunk, first, last, header, body)``: changes with ``context`` rows around them, touching
    ones as one. An empty side of a header names the line before."""
    order = W.partitionBy("pair_id").orderBy("row_no")
    left, right = F.col("left_no").isNotNull(), F.col("right_no").isNotNull()
    r = rows.withColumn("o", F.sum(left.cast("int")).over(order)).withColumn("n", F.sum(right.cast("int")).over(order))
    r = r.withColumn("same", (F.col("kind") == "equal") & F.col("old_line").eqNullSafe(F.col("new_line")))
    around = W.partitionBy("pair_id").orderBy("row_no").rowsBetween(-context, context)
    r = r.withColumn("near", F.max((~F.col("same")).cast("int")).over(around)).where("near = 1")
    r = r.withColumn("new", F.when(F.lag("row_no").over(order) == F.col("row_no") - 1, 0).otherwise(1)).withColumn("hunk", F.sum("new").over(order))
    minus = F.when(left, F.concat(F.when(F.col("same"), " ").otherwise("-"), "old_line"))
    plus = F.when(right & ~F.col("same"), F.concat(F.lit("+"), "new_line"))
    side = lambda last, n: F.concat(F.when(n == 0, last).otherwise(last - n + 1).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))
    h = r.groupBy("pair_id", "hunk").agg(
        F.min("row_no").alias("first"), F.max("row_no").alias("last"), F.max("o").alias("o1"), F.count(F.when(left, 1)).alias("on"), F.max("n").alias("n1"), F.count(F.when(right, 1)).alias("nn"),
        F.array_sort(F.collect_list(F.struct("row_no", F.array_compact(F.array(minus, plus)).alias("l")))).alias("rows"),
    )
    head = F.concat(F.lit("@@ -"), side(F.col("o1"), F.col("on")), F.lit(" +"), side(F.col("n1"), F.col("nn")), F.lit(" @@"))
    body = F.array_join(F.flatten(F.transform("rows", lambda s: s["l"])), "\n")
    return h.select("pair_id", "hunk", "first", "last", head.alias("header"), body.alias("body"))


def unified(rows: DataFrame, context: int = 3) -> DataFrame:
    """``(pair_id, diff)``: the hunks of each pair with changes, in unified form."""
    g = hunks(rows, context).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("hunk", F.concat_ws("\n", "header", "body").alias("text")))).alias("h"))
    return g.select("pair_id", F.array_join(F.transform("h", lambda s: s["text"]), "\n").alias("diff"))


def new_version(rows: DataFrame) -> DataFrame:
    """The whole new text of each pair."""
    r = rows.where("right_no is not null").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("right_no", "new_line"))).alias("l"))
    return r.select("pair_id", F.array_join(F.transform("l", lambda s: s["new_line"]), "\n").alias("text"))


STYLE = "table{border-collapse:collapse;width:100%}td{vertical-align:top;padding:2px 6px}del{background:#fdd}ins{background:#dfd;text-decoration:none}.moved-out,.moved-in{background:#eef}summary{color:#666}"


def html_report(rows: DataFrame, comments: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """``(pair_id, html)``: a table of the rows of each pair with words marked, moves told and unchanged
    gaps folded away (those left out whole only counted); everything is escaped. ``comments`` says what
    placeholders stand for, by character."""
    from folioflow.kernels.prose import balloon
    from folioflow.kernels.words import MARKS, marked_html

    known = dict(comments or {})

    def shown(html: str) -> str:
        return re.sub(f"[{MARKS}]", lambda m: balloon(*known[m.group()]) if m.group() in known else "", html)

    @F.pandas_udf("array<string>")
    def cells(kind: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([[shown(x) for x in marked_html(o, n, k)] for k, o, n in zip(kind, old, new, strict=True)])

    omitted = F.col("omitted") if "omitted" in rows.columns else F.lit(False)
    r = rows.where(~omitted).withColumn("_c", cells("kind", "old_line", "new_line"))
    cell = lambda no, k: F.concat(F.lit("<td>"), F.coalesce(no.cast("string"), F.lit("")), F.lit("</td><td>"), F.col("_c")[k], F.lit("</td>"))
    row = F.concat(F.lit('<tr class="'), F.col("kind"), F.lit('">'), cell(F.col("left_no"), 0), cell(F.col("right_no"), 1), F.lit("<td>"), escape_html(F.array_join("changes", "; ")), F.lit("</td></tr>"))
    one = r.select("pair_id", "row_no", F.when(F.col("shown"), row).otherwise(F.regexp_replace(row, "^<tr ", "<tr hidden ")).alias("h"))
    gaps = skips(rows).select("pair_id", (F.col("after") + 0.5).alias("row_no"), F.concat(F.lit('<tr><td colspan="5"><details><summary>'), F.col("hidden").cast("string"), F.when(F.col("omitted"), " unchanged lines left out").otherwise(" unchanged lines"), F.lit("</summary></details></td></tr>")).alias("h"))
    g = one.withColumn("row_no", F.col("row_no").cast("double")).union(gaps).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "h"))).alias("r"))
    return g.select("pair_id", F.concat(F.lit(f"<!doctype html><meta charset=utf-8><style>{STYLE}</style><table>"), F.array_join(F.transform("r", lambda s: s["h"]), ""), F.lit("</table>")).alias("html"))


def write_text(texts: DataFrame, folder: str, column: str) -> None:
    """All texts under ``folder`` as Parquet of ``(pair_id, text)``; ``write_files`` makes files of them."""
    texts.select("pair_id", F.col(column).alias("text")).write.mode("overwrite").parquet(folder)


def write_files(texts: DataFrame, folder: str, column: str, suffix: str = ".txt") -> DataFrame:
    """One file a pair under ``folder``, which all executors see, written where the rows are:
    ``(pair_id, path)``. Names that are no safe paths are escaped."""

    def run(batches):
        for b in batches:
            paths = []
            for pair, text in zip(b["pair_id"], b["text"], strict=True):
                name = "".join(c if c.isalnum() or c in "-_. /" else f"%{ord(c):x}" for c in str(pair)).replace("..", "%2e%2e").strip("/")
                path = os.path.join(folder, name + suffix)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass"))
                paths.append(path)
            yield pd.DataFrame({"pair_id": b["pair_id"].astype(str), "path": paths})

    return texts.select("pair_id", F.col(column).alias("text")).mapInPandas(run, "pair_id string, path string")
