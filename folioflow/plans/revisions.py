"""Queries on revisions, each with its SQL.

Every document is compared with a revision made of it by rule, the same in both engines:
each 7th line (by number, 3 of 7) is dropped, each 5th (2 of 5) gets ``(revised)`` at its end,
the first line moves to the end, the last stays. All documents and all their lines take part.
The operators see only the two texts; the SQL knows the rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow.functions import text as X
from folioflow.kernels.lines import token_similarity
from folioflow.operators.diff import counts, counts_with_subtotals, diff_rows, folded, skips, stops
from folioflow.operators.folders import compare_folders, fingerprints_changed
from folioflow.operators.similarity import mutual_best, rare_word_candidates, similar_lines
from folioflow.plans.prose import LINES_SQL, NONBLANK_SQL, SPACED_SQL, TOKENS_SQL, WORDS_SQL, big, lines
from folioflow.session import cut_lineage, table
from folioflow.sources.sinks import hunks as diff_hunks

# Every line gets four words of its own in front, so which line became which is beyond doubt.
KNOWN_SQL = """,
marked AS (SELECT doc_id, idx, md5(doc_id || '/' || idx) AS h, line AS text, count(*) OVER (PARTITION BY doc_id) AS n FROM lines),
known AS (SELECT doc_id, idx, n, substr(h, 1, 8) || ' ' || substr(h, 9, 8) || ' ' || substr(h, 17, 8) || ' ' || substr(h, 25, 8) || ' ' || text AS line,
  CASE WHEN idx = 0 AND n > 1 THEN 'moved-out' WHEN idx % 7 = 3 AND idx < n - 1 THEN 'delete' WHEN idx % 5 = 2 AND idx < n - 1 THEN 'replace' ELSE 'equal' END AS kind FROM marked)"""
ROWS_SQL = KNOWN_SQL + """,
r0 AS (SELECT doc_id, idx AS ord, kind, idx + 1 AS left_no, CASE WHEN kind IN ('equal', 'replace') THEN count(*) FILTER (kind IN ('equal', 'replace')) OVER (PARTITION BY doc_id ORDER BY idx) END AS right_no, line AS old_line,
    CASE kind WHEN 'equal' THEN line WHEN 'replace' THEN line || '(revised)' END AS new_line FROM known WHERE n > 1
  UNION ALL SELECT doc_id, 1000000000, 'moved-in', NULL, (SELECT count(*) + 1 FROM known k WHERE k.doc_id = known.doc_id AND k.kind IN ('equal', 'replace')), NULL, line FROM known WHERE kind = 'moved-out'),
rows_ AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS row_no, kind, left_no, right_no, old_line, new_line, coalesce(old_line, new_line) AS line FROM r0)"""


def known_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, idx, line, kind``: all lines with words of their own in front, and what becomes of each."""
    d = lines(spark, sf)
    h = F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("idx").cast("string")).cast("binary"))
    d = d.withColumn("h", h).withColumn("line", F.concat_ws(" ", *[F.substring("h", k, 8) for k in (1, 9, 17, 25)], "line"))
    d = d.withColumn("n", F.count("*").over(W.partitionBy("doc_id")))  # no join, which would send a row for each document to all workers
    inside = F.col("idx") < F.col("n") - 1
    kind = F.when((F.col("idx") == 0) & (F.col("n") > 1), "moved-out").when((F.col("idx") % 7 == 3) & inside, "delete").when((F.col("idx") % 5 == 2) & inside, "replace").otherwise("equal")
    return d.select("doc_id", "idx", "line", kind.alias("kind"))


def known_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its known revision: ``pair_id, old, new``."""
    d = known_lines(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line", "kind"))).alias("x"))
    line = lambda s: s["line"]
    kept = F.transform(F.filter("x", lambda s: s["kind"].isin("equal", "replace")), lambda s: F.when(s["kind"] == "replace", F.concat(s["line"], F.lit("(revised)"))).otherwise(s["line"]))
    moved = F.transform(F.filter("x", lambda s: s["kind"] == "moved-out"), line)
    return d.select(F.col("doc_id").alias("pair_id"), F.transform("x", line).alias("old"), F.concat(kept, moved).alias("new"))


def known_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that the operator finds for the known revisions."""
    return diff_rows(known_pairs(spark, sf))


def new_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A revision of the lines as they are, copies and all: each 7th (3 of 7) dropped, each 5th (2 of 5) edited, the first at the end."""
    kept = lines(spark, sf).where(F.col("idx") % 7 != 3)
    order = W.partitionBy("doc_id").orderBy(F.when(F.col("idx") == 0, 1_000_000_000).otherwise(F.col("idx")))
    text = F.when(F.col("idx") % 5 == 2, F.concat("line", F.lit(" (revised)"))).otherwise(F.col("line"))
    return kept.select("doc_id", (F.row_number().over(order) - 1).cast("bigint").alias("idx"), F.col("idx").alias("was"), text.alias("line"))


NEW_SQL = """,
newlines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN idx = 0 THEN 1000000000 ELSE idx END) - 1 AS idx, idx AS was, CASE WHEN idx % 5 = 2 THEN line || ' (revised)' ELSE line END AS line FROM lines WHERE idx % 7 <> 3)"""


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.concat_ws("/", "project", "source", F.col("doc_id").cast("string")).alias("path"))
    k = F.col("doc_id") % 10
    new = d.where(k != 0).select(F.when(k == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(k == 2, F.concat("content", F.lit("\nadded line"))).otherwise(F.col("content")).alias("content"))
    extra = d.where(k == 3).select(F.concat(F.lit("added/"), "path"), F.concat("content", F.lit(" copy"), "path"))
    return d.select("path", "content"), new.union(extra)


def folder_compare(spark, sf):
    return compare_folders(*snapshots(spark, sf), renames=False)


def folder_compare_common(spark, sf):
    return compare_folders(*snapshots(spark, sf), common_only=True)


def rename_detect(spark, sf):
    return compare_folders(*snapshots(spark, sf))


def changed_fingerprints(spark, sf):
    return fingerprints_changed(*snapshots(spark, sf))


def line_multiset_counts(spark, sf):
    """Lines kept, removed and added per document, the k-th copy of a line with the k-th."""
    k = F.row_number().over(W.partitionBy("doc_id", "line").orderBy("idx"))
    o = lines(spark, sf).select("doc_id", "line", k.alias("k"), F.lit(1).alias("o"))
    n = new_lines(spark, sf).select("doc_id", "line", k.alias("k"), F.lit(1).alias("n"))
    j = o.join(n, ["doc_id", "line", "k"], "full_outer")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    return j.groupBy("doc_id").agg(F.count(F.when(both, 1)).alias("lines_kept"), F.count(F.when(F.col("n").isNull(), 1)).alias("lines_removed"), F.count(F.when(F.col("o").isNull(), 1)).alias("lines_added"))


def _lone(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The lines that the alignment leaves without an equal on the other side."""
    r = known_rows(spark, sf).where("kind <> 'equal'").select(F.col("pair_id").alias("doc_id"), "left_no", "right_no", "old_line", "new_line")
    r = cut_lineage(r)  # both sides come of one comparison
    return r.where("left_no is not null").select("doc_id", (F.col("left_no") - 1).alias("i"), F.col("old_line").alias("line")), r.where("right_no is not null").select("doc_id", (F.col("right_no") - 1).alias("j"), F.col("new_line").alias("line"))


def exact_moves(spark, sf):
    """The k-th removed line of a key with its k-th added line."""
    old, new = _lone(spark, sf)
    k = lambda c: F.row_number().over(W.partitionBy("doc_id", "key").orderBy(c))
    a = old.withColumn("key", X.move_key(F.col("line"))).where("key is not null").withColumn("k", k("i"))
    b = new.withColumn("key", X.move_key(F.col("line"))).where("key is not null").withColumn("k", k("j"))
    return a.join(b.drop("line"), ["doc_id", "key", "k"]).select("doc_id", "i", "j")


def moved_lines_fuzzy(spark, sf):
    """Removed lines with added lines like them: how many, and the likest."""
    old, new = _lone(spark, sf)
    long = lambda d: d.where(X.move_key(F.col("line")).isNotNull())
    p = similar_lines(long(old), long(new), "doc_id", 0.7)
    best = F.max(F.struct("score", (-F.col("j")).alias("m")))
    return p.groupBy("doc_id", "i").agg(F.count("*").alias("links"), best.alias("b")).select("doc_id", "i", "links", F.round("b.score", 6).alias("score"), (-F.col("b.m")).alias("j"))


def moved_lines_matched(spark, sf):
    """One-to-one moves by falling similarity."""
    old, new = _lone(spark, sf)
    long = lambda d: d.where(X.move_key(F.col("line")).isNotNull())
    return mutual_best(similar_lines(long(old), long(new), "doc_id", 0.7), "doc_id").select("doc_id", "i", "j", F.round("score", 6).alias("score"))


def rare_word_blocking(spark, sf):
    """Candidate partners by shared rare words: how many per passage, and the most words shared."""
    old, new = _lone(spark, sf)
    p = rare_word_candidates(old.select("doc_id", "i", X.content_words(F.col("line")).alias("words")), new.select("doc_id", "j", X.content_words(F.col("line")).alias("words")), "doc_id")
    return p.groupBy("doc_id", "i").agg(F.count("*").alias("candidates"), F.max("shared").alias("most"))


def token_similarities(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, similarity)`` of ``pairs(*keys, a, b)``, token arrays of any length."""
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = [token_similarity(a, b) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(t.column(k) for k in keys), pa.array(x, pa.float64())], [*keys, "similarity"])

    return pairs.select(*keys, "a", "b").mapInArrow(run, f"{kinds}, similarity double")


def ordered_similarity(spark, sf):
    """LCS similarity of each revised line with what it was. """
    d = lines(spark, sf).where("idx % 5 = 2").withColumn("a", X.similarity_tokens(F.col("line")))
    d = d.withColumn("b", X.similarity_tokens(F.concat("line", F.lit(" (revised)"))))
    return token_similarities(d, ["doc_id", "idx"]).withColumn("similarity", F.round("similarity", 6))


def file_counts(spark, sf):
    return counts(known_rows(spark, sf), F.col("pair_id").alias("doc_id"))


def total_counts(spark, sf):
    return counts(known_rows(spark, sf), F.lit("all").alias("pair_id")).drop("pair_id")


def counts_rollup(spark, sf):
    """Counts per project and file with subtotals and the total."""
    r = known_rows(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), "project"), "pair_id")
    return counts_with_subtotals(r, "project", "pair_id").withColumnRenamed("pair_id", "doc_id")


def first_of_change(spark, sf):
    """In code only the first row of each run of changes is a stop."""
    return stops(folded(known_rows(spark, sf), context=1), prose=False).where("shown").select(F.col("pair_id").alias("doc_id"), "row_no", F.col("stop").alias("first"))


def context_fold(spark, sf):
    """Which rows show with two rows of context around changes."""
    return folded(known_rows(spark, sf), context=2).select(F.col("pair_id").alias("doc_id"), "row_no", "shown")


def long_gap(spark, sf):
    """Unchanged gaps, those over 3 rows left out whole."""
    return skips(folded(known_rows(spark, sf), context=0, max_hidden=3)).select(F.col("pair_id").alias("doc_id"), "after", "hidden", "omitted")


def hunks(spark, sf):
    """Changes with a row of context each, touching ones merged."""
    return diff_hunks(known_rows(spark, sf), 1).select(F.col("pair_id").alias("doc_id"), big(F.col("hunk")).alias("hunk"), big(F.col("first")).alias("first"), big(F.col("last")).alias("last"))


def hunk_headers(spark, sf):
    """Header of each hunk of a unified diff; an empty side names the line before."""
    return diff_hunks(known_rows(spark, sf), 1).select(F.col("pair_id").alias("doc_id"), big(F.col("hunk")).alias("hunk"), "header")


QUERIES = {f.__name__: f for f in (folder_compare, folder_compare_common, rename_detect, changed_fingerprints, line_multiset_counts, exact_moves, moved_lines_fuzzy, moved_lines_matched, rare_word_blocking, ordered_similarity, file_counts, total_counts, counts_rollup, first_of_change, context_fold, long_gap, hunks, hunk_headers)}

SNAP_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS content, concat_ws('/', project, source, doc_id) AS path FROM documents),
o AS (SELECT path, content FROM d),
n AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 10 = 2 THEN content || chr(10) || 'added line' ELSE content END AS content FROM d WHERE doc_id % 10 <> 0
  UNION ALL SELECT 'added/' || path, content || ' copy' || path FROM d WHERE doc_id % 10 = 3),
c AS (SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.path AS old_path, n.path AS new_path, o.content AS oc, n.content AS nc
  FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.content IS DISTINCT FROM n.content)"""
LONE_SQL = f""",
oldl AS (SELECT doc_id, left_no - 1 AS i, old_line AS line FROM rows_ WHERE kind <> 'equal' AND left_no IS NOT NULL),
newl AS (SELECT doc_id, right_no - 1 AS j, new_line AS line FROM rows_ WHERE kind <> 'equal' AND right_no IS NOT NULL),
ok AS (SELECT *, CASE WHEN {NONBLANK_SQL} >= 20 THEN {SPACED_SQL} END AS key FROM oldl),
nk AS (SELECT *, CASE WHEN {NONBLANK_SQL} >= 20 THEN {SPACED_SQL} END AS key FROM newl)"""
SIMTOK = f"list_filter({TOKENS_SQL}, lambda x: NOT regexp_matches(x, '^([\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]|[\\x{{E000}}-\\x{{F8FF}}])'))"
COUNTS_SQL = f"""count(*) FILTER (kind = 'replace') AS additions, count(*) FILTER (kind IN ('replace', 'delete')) AS deletions, count(*) FILTER (kind = 'replace') AS words_added, CAST(sum(CASE WHEN kind = 'delete' THEN len({WORDS_SQL}) ELSE 0 END) AS BIGINT) AS words_removed,
count(*) FILTER (kind = 'moved-out') AS moved_lines, CAST(0 AS BIGINT) AS moved_passages, count(*) FILTER (kind = 'replace') AS edited_lines, CAST(0 AS BIGINT) AS inserted_lines, count(*) FILTER (kind = 'delete') AS deleted_lines"""
GAPS_SQL = """,
g AS (SELECT *, CASE WHEN kind <> 'equal' THEN 1 ELSE 0 END AS changed, sum(CASE WHEN kind <> 'equal' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_no) AS gap FROM rows_),
gg AS (SELECT *, max(gap) OVER (PARTITION BY doc_id) AS last_gap, row_number() OVER (PARTITION BY doc_id, gap, changed ORDER BY row_no) AS up, row_number() OVER (PARTITION BY doc_id, gap, changed ORDER BY row_no DESC) AS down FROM g)"""
HUNKS_SQL = """,
c0 AS (SELECT r.doc_id, greatest(row_no - 1, 1) AS a, least(row_no + 1, m.n) AS b FROM rows_ r JOIN (SELECT doc_id, max(row_no) AS n FROM rows_ GROUP BY doc_id) m ON m.doc_id = r.doc_id WHERE kind <> 'equal'),
c1 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM c0),
c2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b) AS hunk FROM c1),
h AS (SELECT doc_id, CAST(hunk AS BIGINT) AS hunk, min(a) AS first, max(b) AS last FROM c2 GROUP BY ALL)"""
L, LN, LR = f"WITH {LINES_SQL}", f"WITH {LINES_SQL} {NEW_SQL}", f"WITH {LINES_SQL} {ROWS_SQL}"
SCORES_SQL = f""",
ot AS (SELECT doc_id, i, len({SIMTOK}) AS n, {SIMTOK} AS l FROM ok WHERE key IS NOT NULL),
nt AS (SELECT doc_id, j, len({SIMTOK}) AS n, {SIMTOK} AS l FROM nk WHERE key IS NOT NULL),
oe AS (SELECT doc_id, i, n, t, count(*) AS c FROM (SELECT doc_id, i, n, unnest(l) AS t FROM ot) GROUP BY ALL),
ne AS (SELECT doc_id, j, n, t, count(*) AS c FROM (SELECT doc_id, j, n, unnest(l) AS t FROM nt) GROUP BY ALL),
sc AS (SELECT oe.doc_id, i, j, 2.0 * sum(least(oe.c, ne.c)) / (any_value(oe.n) + any_value(ne.n)) AS score FROM oe JOIN ne ON oe.doc_id = ne.doc_id AND oe.t = ne.t GROUP BY oe.doc_id, i, j HAVING 2.0 * sum(least(oe.c, ne.c)) / (any_value(oe.n) + any_value(ne.n)) >= 0.7 - 1e-9)"""
FOLDED = f"list_filter(list_transform({WORDS_SQL}, lambda w: replace(lower(replace(w, 'İ', 'i̇')), 'ß', 'ss')), lambda w: len(w) >= 4)"
SQL = {
    "folder_compare": f"{SNAP_SQL} SELECT change, old_path, new_path FROM c",
    "folder_compare_common": f"{SNAP_SQL} SELECT 'modified' AS change, o.path AS old_path, n.path AS new_path FROM o JOIN n ON o.path = n.path WHERE o.content <> n.content",
    "rename_detect": f"{SNAP_SQL}, g AS (SELECT old_path, oc, row_number() OVER (PARTITION BY oc ORDER BY old_path) AS k FROM c WHERE change = 'deleted'), a AS (SELECT new_path, nc, row_number() OVER (PARTITION BY nc ORDER BY new_path) AS k FROM c WHERE change = 'added'), m AS (SELECT old_path, new_path FROM g JOIN a ON g.oc = a.nc AND g.k = a.k) "
    + "SELECT change, old_path, new_path FROM c WHERE NOT (change = 'deleted' AND old_path IN (SELECT old_path FROM m)) AND NOT (change = 'added' AND new_path IN (SELECT new_path FROM m)) UNION ALL SELECT 'renamed', old_path, new_path FROM m",
    "changed_fingerprints": f"{SNAP_SQL} SELECT o.path FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = o.path AND n.content = o.content)",
    "line_multiset_counts": f"{LN}, o AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS k FROM lines), n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS k FROM newlines) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, count(*) FILTER (o.k IS NOT NULL AND n.k IS NOT NULL) AS lines_kept, count(*) FILTER (n.k IS NULL) AS lines_removed, count(*) FILTER (o.k IS NULL) AS lines_added FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id AND o.line = n.line AND o.k = n.k GROUP BY 1",
    "exact_moves": f"{LR} {LONE_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS k FROM ok WHERE key IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY j) AS k FROM nk WHERE key IS NOT NULL) SELECT a.doc_id, i, j FROM a JOIN b ON a.doc_id = b.doc_id AND a.key = b.key AND a.k = b.k",
    "moved_lines_fuzzy": f"{LR} {LONE_SQL} {SCORES_SQL} SELECT doc_id, i, count(*) AS links, round(max(score), 6) AS score, min(j) FILTER (score = m) AS j FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, i) AS m FROM sc) GROUP BY doc_id, i",
    "rare_word_blocking": f"{LR} {LONE_SQL}, ow AS (SELECT DISTINCT doc_id, i, unnest({FOLDED}) AS word FROM oldl), nw AS (SELECT DISTINCT doc_id, j, unnest({FOLDED}) AS word FROM newl), np AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM oldl UNION ALL SELECT doc_id FROM newl) GROUP BY doc_id), df AS (SELECT doc_id, word, count(*) AS df FROM (SELECT doc_id, word FROM ow UNION ALL SELECT doc_id, word FROM nw) GROUP BY ALL), "
    + "rare AS (SELECT df.doc_id, word FROM df JOIN np ON np.doc_id = df.doc_id WHERE df <= greatest(20.0, n * 0.01)), p AS (SELECT ow.doc_id, i, j, count(*) AS shared FROM ow JOIN rare ON rare.doc_id = ow.doc_id AND rare.word = ow.word JOIN nw ON nw.doc_id = ow.doc_id AND nw.word = ow.word GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, i, j) AS r FROM p) SELECT doc_id, i, count(*) AS candidates, max(shared) AS most FROM q WHERE r <= 250000 GROUP BY doc_id, i",
    "ordered_similarity": f"{L} SELECT doc_id, idx, round(2.0 * n / (2 * n + 3), 6) AS similarity FROM (SELECT doc_id, idx, len({SIMTOK}) AS n FROM lines WHERE idx % 5 = 2)",
    "moved_lines_matched": f"{LR} SELECT doc_id, left_no - 1 AS i, coalesce(right_no, (SELECT max(right_no) FROM rows_ x WHERE x.doc_id = rows_.doc_id)) - 1 AS j, CASE kind WHEN 'replace' THEN round(2.0 * len({SIMTOK}) / (2 * len({SIMTOK}) + 3), 6) ELSE 1.0 END AS score FROM rows_ WHERE kind IN ('replace', 'moved-out')",
    "file_counts": f"{LR} SELECT doc_id, {COUNTS_SQL} FROM rows_ GROUP BY doc_id",
    "total_counts": f"{LR} SELECT {COUNTS_SQL} FROM rows_",
    "counts_rollup": f"{LR} SELECT project, r.doc_id, {COUNTS_SQL} FROM rows_ r JOIN (SELECT doc_id, project FROM documents) d ON d.doc_id = r.doc_id GROUP BY ROLLUP (project, r.doc_id)",
    "first_of_change": f"{LR}, c AS (SELECT *, kind <> 'equal' AS c, lag(kind <> 'equal', 1, false) OVER w AS before, lead(kind <> 'equal', 1, false) OVER w AS next FROM rows_ WINDOW w AS (PARTITION BY doc_id ORDER BY row_no)) SELECT doc_id, row_no, c AND NOT before AS first FROM c WHERE c OR before OR next",
    "context_fold": f"{LR} {GAPS_SQL} SELECT doc_id, row_no, changed = 1 OR (gap > 0 AND up <= 2) OR (gap < last_gap AND down <= 2) AS shown FROM gg",
    "long_gap": f"{LR} {GAPS_SQL} SELECT doc_id, min(row_no) - 1 AS after, count(*) AS hidden, count(*) > 3 AS omitted FROM gg WHERE changed = 0 GROUP BY doc_id, gap",
    "hunks": f"{LR} {HUNKS_SQL} SELECT * FROM h",
    "hunk_headers": f"{LR} {HUNKS_SQL}, s AS (SELECT *, sum(CASE WHEN kind <> 'moved-in' THEN 1 ELSE 0 END) OVER w AS o, sum(CASE WHEN kind NOT IN ('delete', 'moved-out') THEN 1 ELSE 0 END) OVER w AS n FROM rows_ WINDOW w AS (PARTITION BY doc_id ORDER BY row_no)), "
    + "j AS (SELECT h.doc_id, hunk, max(o) AS o1, count(*) FILTER (kind <> 'moved-in') AS ol, max(n) AS n1, count(*) FILTER (kind NOT IN ('delete', 'moved-out')) AS nl FROM h JOIN s ON s.doc_id = h.doc_id AND row_no BETWEEN first AND last GROUP BY ALL) "
    + "SELECT doc_id, hunk, '@@ -' || CAST(CASE WHEN ol = 0 THEN o1 ELSE o1 - ol + 1 END AS BIGINT) || CASE WHEN ol = 1 THEN '' ELSE ',' || ol END || ' +' || CAST(CASE WHEN nl = 0 THEN n1 ELSE n1 - nl + 1 END AS BIGINT) || CASE WHEN nl = 1 THEN '' ELSE ',' || nl END || ' @@' AS header FROM j",
}
