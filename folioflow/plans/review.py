"""Queries on comments, languages, answers and run history, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from folioflow.functions import text as X
from folioflow.operators.assess import context_conflicts, prompt
from folioflow.plans.prose import big
from folioflow.session import running, salted_join, table

# The verdicts an answer may give.
VERDICTS = ["improves", "worsens", "mixed", "unclear", "good", "poor", "fair", "likely", "unlikely"]
NOTE = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("side", T.StringType()), ("start", T.LongType()), ("problem", T.StringType()), ("replacement", T.StringType()))]))


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "doc_files").select("file_id", "side", F.split("path", "/")[0].alias("project"))
    marks = table(spark, sf, "comment_marks").select("mark_id", "file_id", "author", "text", "resolved").dropDuplicates(["mark_id"])
    return salted_join(marks, files, "file_id", "mark_id", how="inner")


def comment_status(spark, sf):
    """Comments of a project by author and text: on both sides unchanged, else new or removed."""
    side = lambda s: F.max((F.col("side") == s).cast("int"))
    g = _marks(spark, sf).where("text is not null").groupBy("project", "author", "text").agg(side("old").alias("o"), side("new").alias("n"))
    status = F.when((F.col("o") == 1) & (F.col("n") == 1), "unchanged").when(F.col("n") == 1, "new").otherwise("removed")
    return g.groupBy("project", status.alias("status")).agg(F.count("*").alias("n"))


def open_comments(spark, sf):
    """Comments that aren't resolved, per file; resolved ones drop before anything else."""
    return _marks(spark, sf).where("not resolved").groupBy("file_id").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"))


def comment_panel(spark, sf):
    """Entries of the panel in order: lines first to last, those without a line at the end."""
    e = table(spark, sf, "comment_entries").select("entry_id", "file_id", "status", "line").dropDuplicates(["entry_id"])
    r = running(e, "file_id", [F.col("line").asc_nulls_last(), F.col("entry_id")], {"before": F.lit(1)})
    return r.select("entry_id", "file_id", "status", big(F.col("before") + 1).alias("place"))


def entry_status(spark, sf):
    return table(spark, sf, "comment_entries").dropDuplicates(["entry_id"]).groupBy("status").agg(F.count("*").alias("n"))


def comment_key_sets(spark, sf):
    """Comment keys of both sides: how many are shared, only old, only new."""
    m = _marks(spark, sf).where("text is not null")
    side = lambda s: F.max((F.col("side") == s).cast("int"))
    g = m.groupBy(F.coalesce("author", F.lit("")).alias("author"), "text").agg(side("old").alias("o"), side("new").alias("n"))
    part = F.when((F.col("o") == 1) & (F.col("n") == 1), "shared").when(F.col("o") == 1, "only_old").otherwise("only_new")
    return g.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def language_vote(spark, sf):
    """Language of each file by its blocks' letters: a strict majority of the letters of blocks
    that vote (50 letters or more), counted until 20,000 characters are seen."""
    b = table(spark, sf, "blocks").select("block_id", "file_id", "language", "text").dropDuplicates(["block_id"]).where("text is not null")
    base = F.lower(F.regexp_extract("language", "^([A-Za-z]{2})(?:$|[-_])", 1))
    b = b.select("block_id", "file_id", F.when(base.isin("no"), "").otherwise(base).alias("lang"), F.length("text").alias("size"), F.length(F.regexp_replace("text", r"[^\p{L}]", "")).alias("letters"))
    v = running(b, "file_id", [F.col("block_id")], {"before": F.col("size")}).where("before < 20000 and letters >= 50 and lang <> ''")
    g = v.groupBy("file_id", "lang").agg(F.sum("letters").alias("n"))
    t = g.groupBy("file_id").agg(F.max(F.struct("n", "lang")).alias("m"), F.sum("n").alias("total"))
    return t.where(F.col("m.n") * 2 > F.col("total")).select("file_id", F.col("m.lang").alias("lang"), big(F.col("m.n")).alias("letters"), big(F.col("total")).alias("voted"))


def verdict_parse(spark, sf):
    """The first verdict word in the Verdict section, else in the first 200 characters."""
    a = table(spark, sf, "assessments").select("assess_id", "markdown").dropDuplicates(["assess_id"])
    section = F.regexp_extract("markdown", r"(?s)## Verdict\s+(.*?)(?:\n## |$)", 1)
    where = F.when(section != "", section).otherwise(F.substring("markdown", 1, 200))
    found = F.filter(F.regexp_extract_all(F.lower(where), F.lit("([a-z]+)"), F.lit(1)), lambda w: w.isin(VERDICTS))
    return a.select("assess_id", F.try_element_at(found, F.lit(1)).alias("verdict"))


def annotation_parse(spark, sf):
    """Annotations of the last fenced JSON list of each answer; those without a place are dropped."""
    a = table(spark, sf, "assessments").select("assess_id", "markdown").dropDuplicates(["assess_id"])
    fences = F.regexp_extract_all("markdown", F.lit(r"(?s)```json\n(.*?)\n```"), F.lit(1))
    notes = F.from_json(F.try_element_at(fences, F.lit(-1)), NOTE)
    d = a.select("assess_id", F.posexplode(notes).alias("pos", "x"))
    return d.where("x.start is not null and x.side in ('old', 'new')").select("assess_id", big(F.col("pos")).alias("pos"), "x.side", "x.start", "x.problem", "x.replacement")


def run_estimate(spark, sf):
    """Quartiles of the last 20 timed runs of a group with 3 or more, by index."""
    h = table(spark, sf, "assess_history").select("run_id", "date", "ai", "effort", "kind", "seconds").dropDuplicates(["run_id"]).where("seconds > 0 and not isnan(seconds)")
    r = h.withColumn("r", F.row_number().over(W.partitionBy("ai", "effort", "kind").orderBy(F.desc("date"), F.desc("run_id")))).where("r <= 20")
    g = r.groupBy("ai", "effort", "kind").agg(F.sort_array(F.collect_list("seconds")).alias("s"), F.count("*").alias("n")).where("n >= 3")
    at = lambda i: F.element_at("s", (i + 1).cast("int"))
    return g.select("ai", "effort", "kind", "n", at(F.floor(F.col("n") / 4)).alias("low"), at(F.floor(F.col("n") * 3 / 4)).alias("high"))


def estimate_wording(spark, sf):
    e = run_estimate(spark, sf)
    say = lambda c: F.when(c < 60, F.concat(F.floor(c + 0.5).cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(c / 60 + 0.5).cast("string"), F.lit(" min")))
    low, high = say(F.col("low")), say(F.col("high"))
    return e.select("ai", "effort", "kind", F.when(low == high, F.concat(F.lit("usually about "), low)).otherwise(F.concat(F.lit("usually "), low, F.lit(" to "), high)).alias("wording"))


def history_last(spark, sf):
    """The last 200 runs; the cap is the feature."""
    return table(spark, sf, "assess_history").select("run_id", "date", "ai").dropDuplicates(["run_id"]).orderBy(F.desc("date"), F.desc("run_id")).limit(200)


def newest_revisions(spark, sf):
    """The 50 newest assessments and how many there are in all; the cap is the feature."""
    a = table(spark, sf, "assessments").groupBy("assess_id").agg(F.min("loaded_at").alias("t"))
    n = a.count()
    return a.orderBy(F.desc("t"), F.desc("assess_id")).limit(50).select("assess_id", F.lit(n).cast("bigint").alias("total"))


def change_descriptions(spark, sf):
    """What each tracked change does, in words."""
    s = table(spark, sf, "change_spans").select("span_id", "kind", "text").distinct().where("kind in ('insertion', 'deletion') and text is not null and text <> ''")
    empty = F.lit("")
    return s.select("span_id", X.describe(F.when(F.col("kind") == "deletion", F.col("text")).otherwise(empty), F.when(F.col("kind") == "insertion", F.col("text")).otherwise(empty)).alias("description"))


def binary_files(spark, sf):
    """Which texts hold a NUL among their first 8,000 bytes."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.is_binary(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("binary"))


def data_uris(spark, sf):
    """Images as data URIs: every file under a name by its number, of which some are no images and one kind is too large."""
    f = table(spark, sf, "doc_files")
    names = F.array(*[F.lit(x) for x in (".png", ".JPG", ".svg", ".docx", ".gif")])
    path = F.concat("path", F.element_at(names, (F.col("file_id") % 5 + 1).cast("int")))
    content = F.when(F.col("file_id") % 5 == 4, F.repeat(F.lit("0123456789abcdef"), 327_681)).otherwise(F.col("path"))
    return f.select("file_id", X.image_uri(path, F.encode(content, "UTF-8")).alias("uri"))


def prompt_parts(spark, sf):
    """Prompts put together from instruction, subject and the text."""
    d = table(spark, sf, "documents").where("text is not null")
    subject = F.concat(F.coalesce("project", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")))
    return d.select("doc_id", prompt(F.lit("review"), subject, F.col("text"), task=F.lit("Assess the text below.")).alias("prompt"))


def check_context(spark, sf):
    """Files given as context that are analysed too: the new side's files and one project's whole folder are analysed, all files are context."""
    f = table(spark, sf, "doc_files")
    analysed = f.where("side = 'new' and file_id % 2 = 0").select(F.concat(F.lit("./"), F.upper("path")).alias("path")).union(f.where("file_id = 1").select(F.concat(F.split("path", "/")[0], F.lit("/"))))
    return context_conflicts(analysed, f.select("path"))


def all_annotations(spark, sf):
    """The annotations of all checks of a file in one list: check after check in order of arrival, each in its own order."""
    a = table(spark, sf, "assessments").groupBy("assess_id", "file_id", "kind").agg(F.min("loaded_at").alias("t"))
    d = annotation_parse(spark, sf).join(a, "assess_id").select("file_id", "assess_id", "kind", "t", "pos", "side", "start", "problem")
    r = running(d, "file_id", [F.col("t"), F.col("assess_id"), F.col("pos")], {"before": F.lit(1)})
    return r.select("file_id", big(F.col("before") + 1).alias("place"), "assess_id", "kind", "side", "start", "problem")


def document_kinds(spark, sf):
    """Formats on either side of each project, sorted."""
    f = table(spark, sf, "doc_files").select(F.split("path", "/")[0].alias("project"), "file_format")
    return f.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("file_format")), ",").alias("kinds"))


def all_checks(spark, sf):
    """Answers of all checks of a file with one list of kinds, in order of arrival."""
    a = table(spark, sf, "assessments").groupBy("assess_id", "file_id", "kind").agg(F.min("loaded_at").alias("t"))
    g = a.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("t", "assess_id", "kind"))).alias("x"))
    return g.select("file_id", F.array_join(F.transform("x", lambda s: s["kind"]), ",").alias("kinds"), big(F.size("x")).alias("n"))


def markdown_plain(spark, sf):
    """Comment spans folded away: their text goes, the rest stays with one blank."""
    d = table(spark, sf, "documents").where("text is not null")
    gone = F.regexp_replace("text", r"\[([^\[\]]*)\]\{\.(?:comment-start|insertion|deletion)[^}]*\}", "$1")
    return d.select("doc_id", gone.alias("plain"))


def tracked_changes(spark, sf):
    """Insertions, deletions and comments written into documents, with author and minute."""
    d = table(spark, sf, "documents").where("text is not null")
    marks = F.regexp_extract_all("text", F.lit(r"(\]\{\.[^}]*\})"), F.lit(1))
    m = d.select("doc_id", F.posexplode(marks).alias("pos", "m"))
    part = lambda p: F.regexp_extract("m", p, 1)
    return m.select("doc_id", big(F.col("pos")).alias("pos"), part(r"\{\.([a-z-]+)").alias("kind"), part('author="([^"]*)"').alias("author"), X.short_date(part('date="([^"]*)"')).alias("date"))


QUERIES = {f.__name__: f for f in (comment_status, open_comments, comment_panel, entry_status, comment_key_sets, language_vote, verdict_parse, annotation_parse, run_estimate, estimate_wording, history_last, newest_revisions, change_descriptions, binary_files, data_uris, prompt_parts, check_context, document_kinds, all_checks, all_annotations, markdown_plain, tracked_changes)}
MARKS_SQL = "WITH m AS (SELECT DISTINCT mark_id, c.file_id, author, text, resolved, side, split_part(path, '/', 1) AS project FROM comment_marks c JOIN doc_files f ON f.file_id = c.file_id)"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
QUOTED = "'\"' || CASE WHEN len(text) > 60 THEN left(text, 59) || '…' ELSE text END || '\"'"
CUT = "CASE WHEN len(text) <= 300000 THEN text ELSE kept || chr(10) || '[' || (len(text) - len(kept)) || ' more characters of the document left out]' END"
EST_SQL = """h AS (SELECT DISTINCT run_id, date, ai, effort, kind, seconds FROM assess_history WHERE seconds > 0 AND NOT isnan(seconds)),
r AS (SELECT *, row_number() OVER (PARTITION BY ai, effort, kind ORDER BY date DESC, run_id DESC) AS r FROM h),
g AS (SELECT ai, effort, kind, list_sort(list(seconds)) AS s, count(*) AS n FROM r WHERE r <= 20 GROUP BY ai, effort, kind HAVING count(*) >= 3),
e AS (SELECT ai, effort, kind, n, s[CAST(floor(n / 4) AS BIGINT) + 1] AS low, s[CAST(floor(n * 3 / 4) AS BIGINT) + 1] AS high FROM g)"""
SQL = {
    "comment_status": f"{MARKS_SQL}, g AS (SELECT project, author, text, max(CASE WHEN side = 'old' THEN 1 ELSE 0 END) AS o, max(CASE WHEN side = 'new' THEN 1 ELSE 0 END) AS n FROM m WHERE text IS NOT NULL GROUP BY ALL) SELECT project, CASE WHEN o = 1 AND n = 1 THEN 'unchanged' WHEN n = 1 THEN 'new' ELSE 'removed' END AS status, count(*) AS n FROM g GROUP BY 1, 2",
    "open_comments": f"{MARKS_SQL} SELECT file_id, count(*) AS n, count(DISTINCT author) AS authors FROM m WHERE NOT resolved GROUP BY file_id",
    "comment_panel": "SELECT entry_id, file_id, status, row_number() OVER (PARTITION BY file_id ORDER BY line ASC NULLS LAST, entry_id) AS place FROM (SELECT DISTINCT entry_id, file_id, status, line FROM comment_entries)",
    "entry_status": "SELECT status, count(*) AS n FROM (SELECT DISTINCT entry_id, status FROM comment_entries) GROUP BY status",
    "comment_key_sets": f"{MARKS_SQL}, o AS (SELECT DISTINCT coalesce(author, '') AS author, text FROM m WHERE side = 'old' AND text IS NOT NULL), n AS (SELECT DISTINCT coalesce(author, '') AS author, text FROM m WHERE side = 'new' AND text IS NOT NULL) SELECT * FROM (SELECT 'shared' AS part, count(*) AS n FROM (SELECT * FROM o INTERSECT SELECT * FROM n) UNION ALL SELECT 'only_old', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'only_new', count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM o)) WHERE n > 0",
    "language_vote": r"""WITH b AS (SELECT DISTINCT block_id, file_id, lower(regexp_extract(language, '^([A-Za-z]{2})(?:$|[-_])', 1)) AS lang, len(text) AS size, len(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters FROM blocks WHERE text IS NOT NULL),
v AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY file_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
g AS (SELECT file_id, lang, sum(letters) AS n FROM v WHERE before < 20000 AND letters >= 50 AND lang <> '' AND lang <> 'no' GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY file_id) AS total FROM g)
SELECT file_id, lang, CAST(n AS BIGINT) AS letters, CAST(total AS BIGINT) AS voted FROM t WHERE n * 2 > total""",
    "verdict_parse": r"""WITH a AS (SELECT DISTINCT assess_id, markdown FROM assessments), s AS (SELECT assess_id, markdown, regexp_extract(markdown, '(?s)## Verdict\s+(.*?)(?:\n## |$)', 1) AS section FROM a)
SELECT assess_id, list_filter(regexp_extract_all(lower(CASE WHEN section <> '' THEN section ELSE left(markdown, 200) END), '[a-z]+'), lambda w: list_contains(['improves','worsens','mixed','unclear','good','poor','fair','likely','unlikely'], w))[1] AS verdict FROM s""",
    "annotation_parse": r"""WITH a AS (SELECT DISTINCT assess_id, markdown FROM assessments), f AS (SELECT assess_id, regexp_extract_all(markdown, '(?s)```json\n(.*?)\n```', 1) AS l FROM a),
j AS (SELECT assess_id, from_json(l[len(l)], '[{"side":"VARCHAR","start":"BIGINT","problem":"VARCHAR","replacement":"VARCHAR"}]') AS x FROM f WHERE len(l) > 0),
u AS (SELECT assess_id, CAST(unnest(range(len(x))) AS BIGINT) AS pos, unnest(x) AS n FROM j)
SELECT assess_id, pos, n.side AS side, n.start AS start, n.problem AS problem, n.replacement AS replacement FROM u WHERE n.start IS NOT NULL AND n.side IN ('old', 'new')""",
    "all_annotations": r"""WITH a AS (SELECT DISTINCT assess_id, markdown FROM assessments), f AS (SELECT assess_id, regexp_extract_all(markdown, '(?s)```json\n(.*?)\n```', 1) AS l FROM a),
j AS (SELECT assess_id, from_json(l[len(l)], '[{"side":"VARCHAR","start":"BIGINT","problem":"VARCHAR","replacement":"VARCHAR"}]') AS x FROM f WHERE len(l) > 0),
u AS (SELECT assess_id, CAST(unnest(range(len(x))) AS BIGINT) AS pos, unnest(x) AS n FROM j),
p AS (SELECT assess_id, pos, n.side AS side, n.start AS start, n.problem AS problem FROM u WHERE n.start IS NOT NULL AND n.side IN ('old', 'new')),
k AS (SELECT assess_id, file_id, kind, min(loaded_at) AS t FROM assessments GROUP BY ALL)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY t, p.assess_id, pos) AS place, p.assess_id, kind, side, start, problem FROM p JOIN k ON k.assess_id = p.assess_id""",
    "run_estimate": f"WITH {EST_SQL} SELECT * FROM e",
    "estimate_wording": f"WITH {EST_SQL}, w AS (SELECT *, CASE WHEN low < 60 THEN CAST(floor(low + 0.5) AS BIGINT) || ' s' ELSE CAST(floor(low / 60 + 0.5) AS BIGINT) || ' min' END AS a, CASE WHEN high < 60 THEN CAST(floor(high + 0.5) AS BIGINT) || ' s' ELSE CAST(floor(high / 60 + 0.5) AS BIGINT) || ' min' END AS b FROM e) SELECT ai, effort, kind, CASE WHEN a = b THEN 'usually about ' || a ELSE 'usually ' || a || ' to ' || b END AS wording FROM w",
    "history_last": "SELECT DISTINCT run_id, date, ai FROM assess_history ORDER BY date DESC, run_id DESC LIMIT 200",
    "newest_revisions": "WITH a AS (SELECT assess_id, min(loaded_at) AS t FROM assessments GROUP BY 1) SELECT assess_id, (SELECT count(*) FROM a) AS total FROM a ORDER BY t DESC, assess_id DESC LIMIT 50",
    "change_descriptions": f"SELECT DISTINCT span_id, CASE WHEN regexp_replace(text, '{SPACE}', '', 'g') = '' THEN CASE kind WHEN 'insertion' THEN 'added a space' ELSE 'removed a space' END ELSE CASE kind WHEN 'insertion' THEN 'added ' ELSE 'removed ' END || {QUOTED} END AS description FROM change_spans WHERE kind IN ('insertion', 'deletion') AND text <> ''",
    "binary_files": "SELECT doc_id, false AS binary FROM documents",
    "data_uris": "SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'data:image/png;base64,' WHEN 1 THEN 'data:image/jpeg;base64,' WHEN 2 THEN 'data:image/svg+xml;base64,' END || base64(encode(path)) AS uri FROM doc_files",
    "prompt_parts": rf"""WITH h AS (SELECT *, left(text, 300000) AS head FROM documents WHERE text IS NOT NULL), k AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN left(head, len(head) - len(regexp_extract(head, '[^\n]*$')) - 1) ELSE head END AS kept FROM h)
SELECT doc_id, 'Assess the text below.' || chr(10) || chr(10) || 'Subject: ' || coalesce(project, '') || '/' || coalesce(source, '') || chr(10) || chr(10) || {CUT} AS prompt FROM k""",
    "check_context": "SELECT path FROM doc_files WHERE (side = 'new' AND file_id % 2 = 0) OR split_part(path, '/', 1) IN (SELECT split_part(path, '/', 1) FROM doc_files WHERE file_id = 1)",
    "document_kinds": "SELECT split_part(path, '/', 1) AS project, string_agg(DISTINCT file_format, ',' ORDER BY file_format) AS kinds FROM doc_files GROUP BY 1",
    "all_checks": "WITH a AS (SELECT assess_id, file_id, kind, min(loaded_at) AS t FROM assessments GROUP BY ALL) SELECT file_id, string_agg(kind, ',' ORDER BY t, assess_id) AS kinds, count(*) AS n FROM a GROUP BY file_id",
    "markdown_plain": r"SELECT doc_id, regexp_replace(text, '\[([^\[\]]*)\]\{\.(?:comment-start|insertion|deletion)[^}]*\}', '\1', 'g') AS plain FROM documents WHERE text IS NOT NULL",
    "tracked_changes": r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '\]\{\.[^}]*\}') AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS m FROM m),
p AS (SELECT doc_id, pos, regexp_extract(m, '\{\.([a-z-]+)', 1) AS kind, regexp_extract(m, 'author="([^"]*)"', 1) AS author, regexp_extract(m, 'date="([^"]*)"', 1) AS d FROM u)
SELECT doc_id, pos, kind, author, CASE WHEN regexp_matches(d, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}') THEN left(d, 10) || ' ' || substr(d, 12, 5) ELSE d END AS date FROM p""",
}
