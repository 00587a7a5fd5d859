"""Queries over whole files: Word and OpenDocument pairs with comments, renumbered notes, revisions of a
tree, edits under review. Each has SQL that knows how the files were made."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions.registry import register_functions
from folioflow.kernels.documents import read_docx
from folioflow.kernels.redline import Redline, check_redline, commented_docx
from folioflow.operators import compare as C, diff as D
from folioflow.plans.prose import LINES_SQL, big
from folioflow.plans.revisions import COUNTS_SQL, KNOWN_SQL, ROWS_SQL, SIMTOK, SNAP_SQL, known_lines, known_pairs, snapshots
from folioflow.session import cut_lineage, table

COMMENTS = ("Which one is meant?", "Gone by now.", "Only just written.")  # on both sides, on the old, on the new one


def word_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every document and its known revision as Word files with comments on the line that stays last but for the moved one."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b[k : k + C.AT_ONCE] for b in batches for k in range(0, len(b), C.AT_ONCE)):
            rows = []
            for p, old, new in zip(b["pair_id"], b["old"], b["new"], strict=True):
                old, new = list(old), list(new)
                at = (len(old) - 1, max(0, len(new) - 2) if len(old) > 1 else 0)
                rows.append((f"{p}.docx", *(commented_docx(lines, [(k, 0, 8, COMMENTS[0]), (k, 9, 17, COMMENTS[own])]) for lines, k, own in ((old, at[0], 1), (new, at[1], 2)))))
            yield pd.DataFrame(rows, columns=["path", "old", "new"])

    f = cut_lineage(known_pairs(spark, sf).where("size(old) > 0").mapInPandas(make, "path string, old binary, new binary"))
    return f.select("path", F.col("old").alias("content")), f.select("path", F.col("new").alias("content"))


def _compared(spark, sf, panel_only: bool = False) -> DataFrame:
    return C.compared(C.file_pairs(*word_files(spark, sf)), panel_only=panel_only)


def document_counts(spark, sf):
    """The nine counts of each pair of Word files; comments are no changes."""
    return D.counts(C.rows_of(_compared(spark, sf)))


def document_panel(spark, sf):
    """The comments of each pair of Word files with their status and place."""
    return C.panel_of(_compared(spark, sf, panel_only=True)).select("pair_id", "author", "text", "status", "label", "anchor")


def renumbered_notes(spark, sf):
    """Markdown files whose notes only changed their numbers: modified files without rows."""
    d = known_pairs(spark, sf).where("size(old) > 0").withColumn("t", F.array_join("old", "\n"))
    path = F.concat(F.col("pair_id").cast("string"), F.lit(".md"))
    text = lambda a, b: F.concat("t", F.lit(f"\n\nSee the first[^{a}] and the second[^{b}].\n\n[^{a}]: A note on the heading of "), path, F.lit(f"\n[^{b}]: What else was said about "), path, F.lit("\n"))
    done = C.compared(C.file_pairs(d.select(path.alias("path"), text("one", "two").alias("content")), d.select(path.alias("path"), text("seven", "three").alias("content"))))
    return done.select("pair_id", "change", big(F.size("rows")).alias("rows"), "error")


def tree_revisions(spark, sf):
    """What changed between two revisions of a tree of files, with lines added and deleted."""
    old, new = snapshots(spark, sf)
    versions = old.withColumn("revision", F.lit("base")).unionByName(new.withColumn("revision", F.lit("target")))
    done = C.compare_revisions(versions, "base", "target")
    n = lambda *kinds: big(F.size(F.filter("rows", lambda r: r["kind"].isin(*kinds))))
    return done.select("change", "old_path", "new_path", n("insert", "replace").alias("additions"), n("delete", "replace").alias("deletions"))


def edits_reviewed(spark, sf):
    """Every document against itself with an edit applied: a line put at its end."""
    d = table(spark, sf, "documents").where("text is not null")
    return D.counts(D.diff_rows(C.review_edits(d, "doc_id", "text", F.concat("text", F.lit("\nReviewed and released.")))))


def redlined_files(spark, sf):
    """Changes tracked inside each new Word file: whether accepting and rejecting them gives both texts,
    and whether the file's comments are still there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, old, new in zip(b["pair_id"], b["old"], b["new"], strict=True):
                r = Redline(bytes(old), bytes(new))
                data = r.write()
                rows.append((p, not check_redline(data, bytes(old), bytes(new)), r.left == 0, len(read_docx(data).comments)))
            yield pd.DataFrame(rows, columns=["pair_id", "both_texts", "whole", "comments"])

    return C.file_pairs(*word_files(spark, sf)).mapInPandas(run, "pair_id string, both_texts boolean, whole boolean, comments bigint")


def sql_functions(spark, sf):
    """Likeness and marked words of edited lines by functions in SQL."""
    register_functions(spark, "folio_")
    known_lines(spark, sf).where("kind = 'replace'").createOrReplaceTempView("folio_edited")
    return spark.sql("""SELECT doc_id, idx, round(folio_token_sort(line, new), 6) AS token_sort, round(folio_ordered_similarity(line, new), 6) AS ordered, folio_line_move_score(line, new) = folio_token_sort(line, new) AS moves, folio_word_line(line, new) = concat(line, '{+(revised)+}') AS marked
        FROM (SELECT *, concat(line, '(revised)') AS new FROM folio_edited)""")


QUERIES = {f.__name__: f for f in (document_counts, document_panel, renumbered_notes, tree_revisions, edits_reviewed, redlined_files, sql_functions)}
SPLIT_SQL = "CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, chr(10))) - CASE WHEN {t} LIKE '%' || chr(10) THEN 1 ELSE 0 END END"
SQL = {
    "document_counts": f"WITH {LINES_SQL} {ROWS_SQL}, c AS (SELECT doc_id, {COUNTS_SQL} FROM rows_ GROUP BY doc_id) SELECT doc_id || '.docx' AS pair_id, * EXCLUDE (doc_id) FROM c UNION ALL SELECT doc_id || '.docx', 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM known WHERE n = 1",
    "document_panel": f"""WITH {LINES_SQL} {KNOWN_SQL}, k AS (SELECT doc_id, max(n) AS n, count(*) FILTER (kind IN ('equal', 'replace')) AS kept, left(max(line) FILTER (idx = n - 1), 60) AS anchor FROM known GROUP BY doc_id)
SELECT doc_id || '.docx' AS pair_id, 'Assessment' AS author, text, status, CAST(CASE status WHEN 'removed' THEN n ELSE kept END AS VARCHAR) AS label, anchor FROM k, (VALUES ('{COMMENTS[0]}', 'unchanged'), ('{COMMENTS[1]}', 'removed'), ('{COMMENTS[2]}', 'new')) c(text, status)""",
    "renumbered_notes": f"WITH {LINES_SQL} SELECT DISTINCT doc_id || '.md' AS pair_id, 'modified' AS change, CAST(0 AS BIGINT) AS rows, CAST(NULL AS VARCHAR) AS error FROM lines",
    "tree_revisions": f"""{SNAP_SQL}, g AS (SELECT old_path, oc, row_number() OVER (PARTITION BY oc ORDER BY old_path) AS k FROM c WHERE change = 'deleted'), a AS (SELECT new_path, nc, row_number() OVER (PARTITION BY nc ORDER BY new_path) AS k FROM c WHERE change = 'added'),
m AS (SELECT old_path, new_path FROM g JOIN a ON g.oc = a.nc AND g.k = a.k), l AS (SELECT *, CASE WHEN oc IS NULL THEN 0 ELSE {SPLIT_SQL.format(t="oc")} END AS ol, CASE WHEN nc IS NULL THEN 0 ELSE {SPLIT_SQL.format(t="nc")} END AS nl FROM c)
SELECT change, old_path, new_path, greatest(nl - ol, 0) AS additions, greatest(ol - nl, 0) AS deletions FROM l WHERE NOT (change = 'deleted' AND old_path IN (SELECT old_path FROM m)) AND NOT (change = 'added' AND new_path IN (SELECT new_path FROM m)) UNION ALL SELECT 'renamed', old_path, new_path, 0, 0 FROM m""",
    "edits_reviewed": rf"""WITH d AS (SELECT doc_id, CASE WHEN text = '' THEN 2 WHEN text LIKE '%' || chr(10) THEN 2 ELSE 1 END AS more FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS pair_id, more AS additions, 0 AS deletions, 3 AS words_added, 0 AS words_removed, 0 AS moved_lines, 0 AS moved_passages, 0 AS edited_lines, more AS inserted_lines, 0 AS deleted_lines FROM d""",
    "sql_functions": f"WITH {LINES_SQL} {KNOWN_SQL}, n AS (SELECT doc_id, idx, len({SIMTOK}) AS n FROM known WHERE kind = 'replace') SELECT doc_id, idx, round(2.0 * n / (2 * n + 3), 6) AS token_sort, round(2.0 * n / (2 * n + 3), 6) AS ordered, true AS moves, true AS marked FROM n",
    "redlined_files": f"WITH {LINES_SQL} SELECT DISTINCT doc_id || '.docx' AS pair_id, true AS both_texts, true AS whole, CAST(2 AS BIGINT) AS comments FROM lines",
}
