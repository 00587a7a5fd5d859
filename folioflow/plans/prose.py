"""Line, token and word queries over whole documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow.functions import text as X
from folioflow.operators.assess import LIMIT
from folioflow.session import running, table

WORD, SPACE = r"[\p{L}\p{N}_]+", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOKEN = rf"{WORD}|{SPACE}+|[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]"
LINES_SQL = r"""
lists AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM lists),
lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS idx, unnest(l) AS line FROM kept)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("idx", "line")).withColumn("idx", F.col("idx").cast("bigint"))


def big(c) -> F.Column:
    return c.cast("bigint")


def split_lines(spark, sf):
    return lines(spark, sf)


def blank_line_drop(spark, sf):
    """Prose keeps lines that aren't blank, under their old numbers."""
    return lines(spark, sf).where(X.spaced(F.col("line")) != "").select("doc_id", (F.col("idx") + 1).alias("label"), "line")


def paragraph_labels(spark, sf):
    """Labels renumbered without the gaps of dropped lines."""
    d = blank_line_drop(spark, sf)
    return d.select("doc_id", "label", big(F.dense_rank().over(W.partitionBy("doc_id").orderBy("label"))).alias("number"))


def tokens_count(spark, sf):
    return lines(spark, sf).select("doc_id", "idx", big(F.size(X.tokens(F.col("line")))).alias("tokens"))


def word_count(spark, sf):
    return lines(spark, sf).select("doc_id", "idx", big(F.size(X.words(F.col("line")))).alias("words"))


def similarity_tokens(spark, sf):
    return lines(spark, sf).select("doc_id", "idx", F.posexplode(X.similarity_tokens(F.col("line"))).alias("pos", "token")).withColumn("pos", big(F.col("pos")))


def token_offsets(spark, sf):
    """Where each token starts, in characters from the start of its line."""
    return _offsets(lines(spark, sf))


def _offsets(d: DataFrame) -> DataFrame:
    t = d.select("doc_id", "idx", F.posexplode(X.tokens(F.col("line"))).alias("pos", "token"))
    before = W.partitionBy("doc_id", "idx").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return t.select("doc_id", "idx", big(F.col("pos")).alias("pos"), "token", big(F.coalesce(F.sum(F.length("token")).over(before), F.lit(0))).alias("start"))


def spaced_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "idx", X.spaced(F.col("line")).alias("spaced"))


def move_key(spark, sf):
    return lines(spark, sf).select("doc_id", "idx", X.move_key(F.col("line")).alias("key"))


def content_words(spark, sf):
    """Content words of each document as a multiset."""
    w = lines(spark, sf).select("doc_id", F.explode(X.content_words(F.col("line"))).alias("word"))
    return w.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def long_enough(spark, sf):
    return lines(spark, sf).select("doc_id", "idx", X.long_enough(F.col("line")).alias("long_enough"))


def word_frequency(spark, sf):
    """In how many documents each word occurs."""
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(X.words(F.col("text")), X.fold))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("documents"))


def html_escape(spark, sf):
    return lines(spark, sf).select("doc_id", "idx", X.escape_html(F.col("line")).alias("html"))


def prompt_cut(spark, sf):
    """Texts as prompts take them."""
    return table(spark, sf, "documents").select("doc_id", X.cut(F.col("text"), LIMIT).alias("cut"))


def heading_numbers(spark, sf):
    """Outline numbers of Markdown headings; the shallowest level of a document comes first."""
    d = lines(spark, sf).where(F.col("line").rlike(r"^#{1,6} ")).withColumn("level", big(F.length(F.regexp_extract("line", "^(#+)", 1))))
    d = d.withColumn("top", F.min("level").over(W.partitionBy("doc_id")))
    out = d
    order = W.partitionBy("doc_id").orderBy("idx")
    for k in range(1, 7):
        out = out.withColumn(f"i{k}", F.sum((F.col("level") < k).cast("int")).over(order))
    for k in range(1, 7):
        out = out.withColumn(f"c{k}", F.sum((F.col("level") == k).cast("int")).over(W.partitionBy("doc_id", f"i{k}").orderBy("idx")))
    parts = [F.when((F.col("top") <= k) & (F.col("level") >= k), F.col(f"c{k}").cast("string")) for k in range(1, 7)]
    return out.select("doc_id", "idx", "level", F.concat(F.concat_ws(".", *parts), F.lit(".")).alias("number"))


def footnote_refs(spark, sf):
    """References to notes in the order of their first place, each once."""
    d = lines(spark, sf).where(~F.col("line").rlike(X.FOOTNOTE_DEFINITION))
    r = d.select("doc_id", "idx", F.posexplode(F.regexp_extract_all("line", F.lit(X.FOOTNOTE_REFERENCE), F.lit(1))).alias("pos", "label"))
    first = r.groupBy("doc_id", "label").agg(F.min(F.struct("idx", "pos")).alias("at"), F.count("*").alias("n"))
    return first.select("doc_id", "label", "n", big(F.row_number().over(W.partitionBy("doc_id").orderBy("at"))).alias("number"))


def simple_sentences(spark, sf):
    """Pieces by the simple rule: an end mark, closing marks, then blanks."""
    marked = F.regexp_replace("line", r'([.!?]["”’»)\]]*(?:\[\^[^\]\s]+\])*)[ \t]+', "$1\n")
    p = lines(spark, sf).select("doc_id", "idx", F.posexplode(F.filter(F.split(marked, "\n"), lambda s: F.trim(s) != "")).alias("pos", "sentence"))
    return p.select("doc_id", "idx", big(F.col("pos")).alias("pos"), F.trim("sentence").alias("sentence"))


def sentence_labels(spark, sf):
    """``line.sentence`` where a line has several sentences, else the line alone."""
    s = simple_sentences(spark, sf)
    n = F.count("*").over(W.partitionBy("doc_id", "idx"))
    k = F.row_number().over(W.partitionBy("doc_id", "idx").orderBy("pos"))
    line = (F.col("idx") + 1).cast("string")
    return s.select("doc_id", "idx", "pos", F.when(n > 1, F.concat(line, F.lit("."), k.cast("string"))).otherwise(line).alias("label"))


def natural_order(spark, sf):
    """Keys that sort paths so that 2 comes before 10."""
    return table(spark, sf, "doc_files").select("file_id", X.natural_key(F.concat_ws("/", "path", F.repeat(F.col("file_id").cast("string"), 4))).alias("sort_key"))


def file_suffixes(spark, sf):
    return table(spark, sf, "doc_files").select("file_id", X.suffix_of(F.col("path")).alias("suffix"))


def include_globs(spark, sf):
    return table(spark, sf, "doc_files").where(X.included(F.col("path"), "*.DOCX | */review/*.md|appendix_?.*")).select("file_id", "path")


def path_filter(spark, sf):
    return table(spark, sf, "doc_files").where(X.in_paths(F.col("path"), ["harbour-handbook/review", "proj-0003/"])).select("file_id", "path")


def short_dates(spark, sf):
    return table(spark, sf, "comment_marks").select("mark_id", X.short_date(F.col("date")).alias("date")).distinct()


def style_runs(spark, sf):
    """Runs of consecutive blocks of one kind in a file, as first and last place and length."""
    b = table(spark, sf, "blocks").select("file_id", "block_id", "kind").distinct()
    # the next row in file and block order, over the ends of tasks too: a file with a third of all blocks isn't one task
    b = running(b, "file_id", [F.col("block_id")], {"before": F.lit(1)})
    last = b.select("file_id", (F.col("before") + 1).alias("before"), F.col("kind").alias("was"))
    b = b.join(last, ["file_id", "before"], "left").withColumn("new", F.when(F.col("was").eqNullSafe(F.col("kind")) & (F.col("before") > 0), 0).otherwise(1))
    b = running(b, "file_id", [F.col("block_id")], {"earlier": F.col("new")}).withColumn("run", F.col("earlier") + F.col("new"))
    return b.groupBy("file_id", "run", "kind").agg(big(F.min("before") + 1).alias("first"), big(F.max("before") + 1).alias("last"), F.count("*").alias("n")).withColumn("run", big(F.col("run")))


TOKENS_SQL = f"regexp_extract_all(line, '{TOKEN}')"
WORDS_SQL = f"regexp_extract_all(line, '{WORD}')"
SPACED_SQL = f"trim(regexp_replace(line, '{SPACE}+', ' ', 'g'))"
NONBLANK_SQL = f"len(regexp_replace(line, '{SPACE}', '', 'g'))"
SENTENCES_SQL = rf""",
marked AS (SELECT doc_id, idx, list_filter(string_split(regexp_replace(line, '([.!?]["”’»)\]]*(?:\[\^[^\]\s]+\])*)[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) <> '') AS l FROM lines),
sentences AS (SELECT doc_id, idx, CAST(unnest(range(len(l))) AS BIGINT) AS pos, trim(unnest(l)) AS sentence FROM marked)"""
QUERIES = {f.__name__: f for f in (split_lines, blank_line_drop, paragraph_labels, tokens_count, word_count, similarity_tokens, token_offsets, spaced_lines, move_key, content_words, long_enough, word_frequency, html_escape, prompt_cut, heading_numbers, footnote_refs, simple_sentences, sentence_labels, natural_order, file_suffixes, include_globs, path_filter, short_dates, style_runs)}
SQL = {
    "split_lines": f"WITH {LINES_SQL} SELECT * FROM lines",
    "blank_line_drop": f"WITH {LINES_SQL} SELECT doc_id, idx + 1 AS label, line FROM lines WHERE {SPACED_SQL} <> ''",
    "paragraph_labels": f"WITH {LINES_SQL} SELECT doc_id, idx + 1 AS label, dense_rank() OVER (PARTITION BY doc_id ORDER BY idx) AS number FROM lines WHERE {SPACED_SQL} <> ''",
    "tokens_count": f"WITH {LINES_SQL} SELECT doc_id, idx, len({TOKENS_SQL}) AS tokens FROM lines",
    "word_count": f"WITH {LINES_SQL} SELECT doc_id, idx, len({WORDS_SQL}) AS words FROM lines",
    "similarity_tokens": f"WITH {LINES_SQL}, t AS (SELECT doc_id, idx, list_filter({TOKENS_SQL}, lambda x: NOT regexp_matches(x, '^({SPACE}|[\\x{{E000}}-\\x{{F8FF}}])')) AS l FROM lines) SELECT doc_id, idx, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS token FROM t",
    "token_offsets": f"WITH {LINES_SQL}, t AS (SELECT doc_id, idx, {TOKENS_SQL} AS l FROM lines), u AS (SELECT doc_id, idx, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS token FROM t) SELECT *, CAST(coalesce(sum(len(token)) OVER (PARTITION BY doc_id, idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u",
    "spaced_lines": f"WITH {LINES_SQL} SELECT doc_id, idx, {SPACED_SQL} AS spaced FROM lines",
    "move_key": f"WITH {LINES_SQL} SELECT doc_id, idx, CASE WHEN {NONBLANK_SQL} >= 20 THEN {SPACED_SQL} END AS key FROM lines",
    "content_words": f"WITH {LINES_SQL}, w AS (SELECT doc_id, replace(lower(replace(unnest({WORDS_SQL}), 'İ', 'i̇')), 'ß', 'ss') AS word FROM lines) SELECT doc_id, word, count(*) AS n FROM w WHERE len(word) >= 4 GROUP BY ALL",
    "long_enough": f"WITH {LINES_SQL} SELECT doc_id, idx, len({WORDS_SQL}) >= 4 AND {NONBLANK_SQL} >= 15 AS long_enough FROM lines",
    "word_frequency": f"WITH w AS (SELECT DISTINCT doc_id, replace(lower(replace(unnest(regexp_extract_all(text, '{WORD}')), 'İ', 'i̇')), 'ß', 'ss') AS word FROM documents) SELECT word, count(*) AS documents FROM w GROUP BY word",
    "html_escape": f"WITH {LINES_SQL} SELECT doc_id, idx, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;') AS html FROM lines",
    "prompt_cut": r"""WITH h AS (SELECT doc_id, text, left(text, 300000) AS head FROM documents),
k AS (SELECT doc_id, text, CASE WHEN contains(head, chr(10)) THEN left(head, len(head) - len(regexp_extract(head, '[^\n]*$')) - 1) ELSE head END AS kept FROM h)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(text) <= 300000 THEN text ELSE kept || chr(10) || '[' || (len(text) - len(kept)) || ' more characters of the text left out]' END AS cut FROM k""",
    "heading_numbers": f"WITH {LINES_SQL}, h AS (SELECT doc_id, idx, CAST(len(regexp_extract(line, '^(#+)', 1)) AS BIGINT) AS level FROM lines WHERE regexp_matches(line, '^#{{1,6}} ')), t AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS top FROM h), "
    + "n AS (SELECT a.doc_id, a.idx, a.level, a.top, k, (SELECT count(*) FROM h b WHERE b.doc_id = a.doc_id AND b.idx <= a.idx AND b.level = k AND b.idx > coalesce((SELECT max(c.idx) FROM h c WHERE c.doc_id = a.doc_id AND c.idx <= a.idx AND c.level < k), -1)) AS c FROM t a, range(1, 7) r(k) WHERE k >= a.top AND k <= a.level) "
    + "SELECT doc_id, idx, level, string_agg(CAST(c AS VARCHAR), '.' ORDER BY k) || '.' AS number FROM n GROUP BY doc_id, idx, level",
    "footnote_refs": f"WITH {LINES_SQL}, r AS (SELECT doc_id, idx, regexp_extract_all(line, '\\[\\^([^\\]\\s]+)\\]', 1) AS l FROM lines WHERE NOT regexp_matches(line, '^\\[\\^([^\\]\\s]+)\\]:[ \\t]*(.*)$')), u AS (SELECT doc_id, idx, unnest(range(len(l))) AS pos, unnest(l) AS label FROM r), g AS (SELECT doc_id, label, count(*) AS n, min(idx * 1000000 + pos) AS first FROM u GROUP BY ALL) SELECT doc_id, label, n, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS number FROM g",
    "simple_sentences": f"WITH {LINES_SQL} {SENTENCES_SQL} SELECT * FROM sentences",
    "sentence_labels": f"WITH {LINES_SQL} {SENTENCES_SQL} SELECT doc_id, idx, pos, CAST(idx + 1 AS VARCHAR) || CASE WHEN count(*) OVER (PARTITION BY doc_id, idx) > 1 THEN '.' || row_number() OVER (PARTITION BY doc_id, idx ORDER BY pos) ELSE '' END AS label FROM sentences",
    "natural_order": r"""WITH p AS (SELECT file_id, path || '/' || repeat(CAST(file_id AS VARCHAR), 4) AS path FROM doc_files) SELECT file_id, array_to_string(list_transform(regexp_extract_all(path, '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(CAST(len(CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END) AS VARCHAR), 6, '0') || CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END ELSE lower(p) END), '') AS sort_key FROM p""",
    "file_suffixes": r"SELECT file_id, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS suffix FROM doc_files",
    "include_globs": "SELECT file_id, path FROM doc_files WHERE lower(path) LIKE '%.docx' OR lower(path) LIKE '%/review/%.md' OR regexp_matches(lower(path), '(^|/)appendix_.\\.[^/]*$')",
    "path_filter": "SELECT file_id, path FROM doc_files WHERE path = 'harbour-handbook/review' OR starts_with(path, 'harbour-handbook/review/') OR path = 'proj-0003' OR starts_with(path, 'proj-0003/')",
    "short_dates": r"SELECT DISTINCT mark_id, CASE WHEN regexp_matches(date, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}') THEN left(date, 10) || ' ' || substr(date, 12, 5) ELSE date END AS date FROM comment_marks",
    "style_runs": """WITH b AS (SELECT DISTINCT file_id, block_id, kind FROM blocks), p AS (SELECT *, row_number() OVER w AS place, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY file_id ORDER BY block_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY block_id) AS run FROM p)
SELECT file_id, CAST(run AS BIGINT) AS run, kind, min(place) AS first, max(place) AS last, count(*) AS n FROM r GROUP BY ALL""",
}
