"""Queries that compare versions line by line and word by word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow.functions import text as X
from folioflow.operators import diff as D
from folioflow.plans.prose import LINES_SQL, NONBLANK_SQL, SPACED_SQL, big, lines
from folioflow.plans.revisions import KNOWN_SQL, LR, COUNTS_SQL, GAPS_SQL, HUNKS_SQL, WORDS_SQL, known_lines, known_rows, new_lines
from folioflow.session import cut_lineage, table
from folioflow.sources.sinks import html_report as _html, new_version, unified


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as it is, copies of lines and all, with the revision made of it by rule."""
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("pair_id"), X.split_lines(F.col("text")).alias("old"))
    n = new_lines(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("x"))
    n = n.select(F.col("doc_id").alias("pair_id"), F.transform("x", lambda s: s["line"]).alias("new"))
    return d.join(n, "pair_id", "left").select("pair_id", "old", F.coalesce("new", F.expr("cast(array() as array<string>)")).alias("new"))


def closest_earlier(d: DataFrame, common: int = 20) -> DataFrame:
    """``d(doc_id, key)``, distinct → ``(old_id, new_id, shared)``: with each document the earlier one
    that shares the most keys, the first of equals. Exact however common a key is: ``common`` only
    says which way a pair is found.

    Pairs with a key of at most ``common`` documents meet by that key. Others share common keys
    only; for these, documents with one set of common keys are alike, so the first of each set
    stands for it and sets are compared, not documents."""
    n = d.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    k = cut_lineage(d.join(n, "key"))
    few, hot = k.where(F.col("n") <= common).drop("n"), k.where(F.col("n") > common).drop("n")
    near = few.alias("a").join(few.alias("b"), "key").where("a.doc_id < b.doc_id").select(F.col("a.doc_id").alias("old_id"), F.col("b.doc_id").alias("new_id")).groupBy("old_id", "new_id").agg(F.count("*").alias("few"))
    sets = hot.groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    old, new = sets.select(F.col("doc_id").alias("old_id"), F.col("keys").alias("ka")), sets.select(F.col("doc_id").alias("new_id"), F.col("keys").alias("kb"))
    both = F.coalesce(F.size(F.array_intersect("ka", "kb")), F.lit(0))
    near = near.join(old, "old_id", "left").join(new, "new_id", "left").select("old_id", "new_id", (F.col("few") + F.when(F.col("ka").isNull() | F.col("kb").isNull(), 0).otherwise(both)).alias("shared"))
    # the first document of each set of common keys, with the earlier first one that shares most of them
    firsts = cut_lineage(sets.groupBy("keys").agg(F.min("doc_id").alias("first")))
    e = firsts.select("first", F.explode("keys").alias("key"))
    met = e.alias("a").join(e.alias("b"), "key").where("a.first < b.first").select(F.col("a.first").alias("old_id"), F.col("b.first").alias("first")).groupBy("old_id", "first").agg(F.count("*").alias("shared"))
    top = met.groupBy("first").agg(F.max(F.struct("shared", (-F.col("old_id")).alias("m"))).alias("top"))
    # the rest of a set share all their common keys with its first, or with an earlier one that has them too
    of = sets.join(firsts, "keys").join(top, "first", "left").select(F.col("doc_id").alias("new_id"), "first", F.size("keys").cast("bigint").alias("size"), F.col("top.shared").alias("s"), (-F.col("top.m")).alias("o"))
    own = (F.col("new_id") > F.col("first")) & (F.col("s").isNull() | (F.col("s") < F.col("size")))
    alike = of.select(F.when(own, F.col("first")).otherwise(F.col("o")).alias("old_id"), "new_id", F.when(own, F.col("size")).otherwise(F.col("s")).alias("shared")).where("old_id is not null")
    best = F.max(F.struct("shared", (-F.col("old_id")).alias("m"))).alias("b")
    return near.unionByName(alike).groupBy("new_id").agg(best).select((-F.col("b.m")).alias("old_id"), "new_id", "b.shared")


def later_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents beside the earlier document that shares the most long lines with them: the pairs
    in which one text may have come of the other."""
    return closest_earlier(lines(spark, sf).withColumn("key", X.move_key(F.col("line"))).where("key is not null").select("doc_id", "key").distinct())


def line_alignment(spark, sf):
    """Rows of every document against its known revision."""
    return known_rows(spark, sf).select("pair_id", "row_no", "kind", "left_no", "right_no", "words_added", "words_removed", "move_pair", F.array_join("changes", "; ").alias("changes"))


def aligned_counts(spark, sf):
    return D.counts(known_rows(spark, sf))


def counts_without_passages(spark, sf):
    return D.counts(moved_rows(spark, sf), passages=False)


def change_counts(spark, sf):
    return D.change_counts(known_rows(spark, sf))


def revision_counts(spark, sf):
    """Changes between each document and the earlier one it comes of."""
    near = later_revisions(spark, sf)
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", X.split_lines(F.col("text")).alias("l"))
    p = near.join(d.select(F.col("doc_id").alias("old_id"), F.col("l").alias("old")), "old_id").join(d.select(F.col("doc_id").alias("new_id"), F.col("l").alias("new")), "new_id")
    return D.counts(D.diff_rows(p.select(F.col("new_id").alias("pair_id"), "old", "new")))


def word_diff(spark, sf):
    """What changed within each edited line, by place."""
    return D.word_changes(known_rows(spark, sf))


def word_diff_text(spark, sf):
    return D.word_lines(known_rows(spark, sf))


def moved_rows(spark, sf) -> DataFrame:
    """Rows where a sentence of six words of its own goes from the end of the first line to that of the last."""
    d = known_lines(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("x")).where(F.size("x") > 2)
    d = d.select(F.col("doc_id").alias("pair_id"), F.transform("x", lambda s: s["line"]).alias("l"), F.md5(F.concat_ws("/", F.lit("moved"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    said = F.concat(F.lit(" And "), F.concat_ws(" ", *[F.substring("h", k, 5) for k in (1, 6, 11, 16, 21)]), F.lit("."))
    rest = lambda a, n: F.slice("l", a, n)
    old = F.concat(F.array(F.concat(F.element_at("l", 1), said)), rest(2, F.size("l") - 1))
    new = F.concat(rest(1, F.size("l") - 1), F.array(F.concat(F.element_at("l", -1), said)))
    return D.diff_rows(d.select("pair_id", old.alias("old"), new.alias("new")))


def moved_passages(spark, sf):
    """Sentences that went from one line to another."""
    r = moved_rows(spark, sf)
    return r.where("size(moved_out) > 0 or size(moved_in) > 0").select("pair_id", "row_no", "kind", F.array_join("moved_out", "|").alias("moved_out"), F.array_join("moved_in", "|").alias("moved_in"), "words_added", "words_removed", "words_added_plain", "words_removed_plain")


def shown_rows(spark, sf):
    return D.folded(known_rows(spark, sf), context=2, max_hidden=3).select("pair_id", "row_no", "kind", "shown", "omitted")


def unified_diff(spark, sf):
    return unified(known_rows(spark, sf), 1)


def html_report(spark, sf):
    """Rows, marks and folded gaps of each report."""
    h = _html(D.folded(known_rows(spark, sf), context=1))
    marks = lambda t: big(F.size(F.split("html", t)) - 1)
    return h.select("pair_id", marks("<tr class=").alias("rows"), marks("<ins>").alias("inserted"), marks("<del>").alias("deleted"), marks("<details>").alias("gaps"))


def new_versions(spark, sf):
    """The whole new text of each revision."""
    return new_version(known_rows(spark, sf))


QUERIES = {f.__name__: f for f in (line_alignment, aligned_counts, counts_without_passages, change_counts, revision_counts, later_revisions, word_diff, word_diff_text, moved_passages, shown_rows, unified_diff, html_report, new_versions)}
MOVED_SQL = KNOWN_SQL + """,
said AS (SELECT doc_id, max(n) AS n, md5('moved/' || doc_id) AS h FROM known GROUP BY doc_id HAVING max(n) > 2),
m AS (SELECT doc_id, n, 'And ' || substr(h, 1, 5) || ' ' || substr(h, 6, 5) || ' ' || substr(h, 11, 5) || ' ' || substr(h, 16, 5) || ' ' || substr(h, 21, 5) || '.' AS s FROM said)"""
SHOW_SQL = "changed = 1 OR (gap > 0 AND up <= {k}) OR (gap < last_gap AND down <= {k})"
SQL = {
    "later_revisions": f"""WITH {LINES_SQL}, d AS (SELECT DISTINCT doc_id, {SPACED_SQL} AS key FROM lines WHERE {NONBLANK_SQL} >= 20),
k AS (SELECT * FROM d WHERE key IN (SELECT key FROM d GROUP BY key HAVING count(*) >= 2)),
n AS (SELECT a.doc_id AS old_id, b.doc_id AS new_id, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY shared DESC, old_id) AS r FROM n)
SELECT old_id, new_id, shared FROM r WHERE r = 1""",
    "line_alignment": f"""{LR} SELECT doc_id AS pair_id, row_no, kind, left_no, right_no, CASE WHEN kind = 'replace' THEN 1 ELSE 0 END AS words_added, CASE WHEN kind = 'delete' THEN len({WORDS_SQL}) ELSE 0 END AS words_removed, CASE WHEN kind LIKE 'moved%' THEN 1 END AS move_pair,
CASE kind WHEN 'replace' THEN 'added "(revised)"' WHEN 'delete' THEN 'removed this line' WHEN 'moved-in' THEN 'moved from line 1' WHEN 'moved-out' THEN 'moved to line ' || (SELECT max(right_no) FROM rows_ x WHERE x.doc_id = rows_.doc_id) ELSE '' END AS changes FROM rows_""",
    "aligned_counts": f"{LR} SELECT doc_id AS pair_id, {COUNTS_SQL} FROM rows_ GROUP BY doc_id",
    "counts_without_passages": f"WITH {LINES_SQL} {MOVED_SQL} SELECT doc_id AS pair_id, 2 AS additions, 2 AS deletions, 6 AS words_added, 6 AS words_removed, 0 AS moved_lines, 0 AS moved_passages, 2 AS edited_lines, 0 AS inserted_lines, 0 AS deleted_lines FROM m",
    "change_counts": f"{LR} SELECT doc_id AS pair_id, count(*) FILTER (kind <> 'equal') AS changes, CAST(0 AS BIGINT) AS formatted FROM rows_ GROUP BY doc_id",
    "word_diff": f"""{LR}, e AS (SELECT doc_id AS pair_id, row_no, len(old_line) AS a, len(new_line) AS b FROM rows_ WHERE kind = 'replace')
SELECT pair_id, row_no, CAST(0 AS BIGINT) AS op, 'equal' AS tag, 0 AS o1, a AS o2, 0 AS n1, a AS n2 FROM e UNION ALL SELECT pair_id, row_no, 1, 'insert', a, a, a, b FROM e""",
    "word_diff_text": f"{LR} SELECT doc_id AS pair_id, row_no, CASE kind WHEN 'equal' THEN new_line WHEN 'replace' THEN old_line || '{{+(revised)+}}' WHEN 'moved-in' THEN '{{+' || new_line || '+}}' ELSE '[-' || old_line || '-]' END AS text FROM rows_",
    "moved_passages": f"WITH {LINES_SQL} {MOVED_SQL} SELECT doc_id AS pair_id, 1 AS row_no, 'replace' AS kind, s AS moved_out, '' AS moved_in, 0 AS words_added, 0 AS words_removed, 0 AS words_added_plain, 6 AS words_removed_plain FROM m UNION ALL SELECT doc_id, n, 'replace', '', s, 0, 0, 6, 0 FROM m",
    "shown_rows": f"{LR} {GAPS_SQL}, t AS (SELECT doc_id AS pair_id, row_no, kind, {SHOW_SQL.format(k=2)} AS shown, count(*) OVER (PARTITION BY doc_id, gap, changed) AS size FROM gg) SELECT pair_id, row_no, kind, shown, NOT shown AND size > 3 AS omitted FROM t",
    "unified_diff": f"""{LR} {HUNKS_SQL}, s AS (SELECT *, count(left_no) OVER w AS o, count(right_no) OVER w AS n FROM rows_ WINDOW w AS (PARTITION BY doc_id ORDER BY row_no)),
j AS (SELECT h.doc_id, hunk, max(o) AS o1, count(left_no) AS ol, max(n) AS n1, count(right_no) AS nl, string_agg(CASE kind WHEN 'equal' THEN ' ' || old_line WHEN 'replace' THEN '-' || old_line || chr(10) || '+' || new_line WHEN 'moved-in' THEN '+' || new_line ELSE '-' || old_line END, chr(10) ORDER BY row_no) AS body FROM h JOIN s ON s.doc_id = h.doc_id AND row_no BETWEEN first AND last GROUP BY ALL)
SELECT doc_id AS pair_id, string_agg('@@ -' || CAST(CASE WHEN ol = 0 THEN o1 ELSE o1 - ol + 1 END AS BIGINT) || CASE WHEN ol = 1 THEN '' ELSE ',' || ol END || ' +' || CAST(CASE WHEN nl = 0 THEN n1 ELSE n1 - nl + 1 END AS BIGINT) || CASE WHEN nl = 1 THEN '' ELSE ',' || nl END || ' @@' || chr(10) || body, chr(10) ORDER BY hunk) AS diff FROM j GROUP BY doc_id""",
    "html_report": f"{LR} {GAPS_SQL}, t AS (SELECT *, {SHOW_SQL.format(k=1)} AS shown FROM gg), u AS (SELECT *, lag(shown, 1, true) OVER (PARTITION BY doc_id ORDER BY row_no) AS before FROM t) SELECT doc_id AS pair_id, count(*) FILTER (shown) AS rows, count(*) FILTER (kind = 'replace') AS inserted, count(*) FILTER (kind = 'delete') AS deleted, count(*) FILTER (NOT shown AND before) AS gaps FROM u GROUP BY doc_id",
    "new_versions": f"{LR} SELECT doc_id AS pair_id, string_agg(new_line, chr(10) ORDER BY row_no) AS text FROM rows_ WHERE right_no IS NOT NULL GROUP BY doc_id",
}
