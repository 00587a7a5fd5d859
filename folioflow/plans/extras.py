"""Further queries: one-sided reviews, whole texts, tags, wordings, checks of the alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import diff as D
from folioflow.plans.prose import LINES_SQL, big, lines
from folioflow.plans.revisions import NEW_SQL
from folioflow.plans.versions import pairs
from folioflow.session import running, table

# Names of the languages that tags are shown with.
LANGUAGES = {"ar": "Arabic", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "fr": "French", "hi": "Hindi", "it": "Italian", "ja": "Japanese", "nl": "Dutch", "pl": "Polish", "pt": "Portuguese", "ru": "Russian", "sv": "Swedish", "th": "Thai", "tr": "Turkish", "uk": "Ukrainian", "zh": "Chinese"}
MOST_REFERENCE = 200_000


def review_rows(spark, sf):
    """One file alone: every line is an equal row of the new side."""
    return lines(spark, sf).select("doc_id", (F.col("idx") + 1).alias("right_no"), F.lit("equal").alias("kind"), F.lit(None).cast("bigint").alias("left_no"))


def reference_texts(spark, sf):
    """Texts given as context: each file's blocks, at most 200,000 characters in all."""
    b = table(spark, sf, "blocks").where("text is not null").select("block_id", "file_id", "text").dropDuplicates(["block_id"])
    b = running(b, "file_id", [F.col("block_id")], {"before": F.length("text") + 1}).where(F.col("before") < MOST_REFERENCE)
    b = b.withColumn("text", F.left("text", (F.lit(MOST_REFERENCE) - F.col("before")).cast("int")))
    g = b.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "text"))).alias("x"))
    return g.select("file_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("reference"))


def language_tags(spark, sf):
    """Tags in one spelling: language in lower case, region in capitals, a hyphen between."""
    c = F.col("language")
    base, region = F.lower(F.regexp_extract(c, "^([A-Za-z]{2,3})(?:[-_]|$)", 1)), F.upper(F.regexp_extract(c, "^[A-Za-z]{2,3}[-_]([A-Za-z]{2})$", 1))
    tag = F.when(c.isNull() | (base == "") | base.isin("und", "zxx", "non"), F.lit(None)).when(region != "", F.concat_ws("-", base, region)).otherwise(base)
    return table(spark, sf, "blocks").groupBy("language", tag.alias("tag")).agg(F.countDistinct("block_id").alias("blocks"))


def language_names(spark, sf):
    """Documents per language by name; unknown tags keep their tag."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    d = table(spark, sf, "documents")
    return d.groupBy(F.coalesce(F.try_element_at(names, F.col("lang")), "lang", F.lit("unknown")).alias("name")).agg(F.count("*").alias("documents"))


def durations(spark, sf):
    """How long runs took, in words."""
    h = table(spark, sf, "assess_history").select("run_id", "seconds").dropDuplicates(["run_id"]).where("seconds >= 0 and not isnan(seconds)")
    s = F.floor(F.col("seconds") + 0.5).cast("bigint")
    say = F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s")))
    return h.select("run_id", say.alias("duration"))


def counted_files(spark, sf):
    """Counts with their noun in one or more."""
    g = table(spark, sf, "doc_files").groupBy("file_format").agg(F.count("*").alias("n"))
    return g.select("file_format", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " file").otherwise(" files")).alias("wording"))


def alignment_rebuilds(spark, sf):
    """Whether the rows of every changed document give both its texts back, line by line."""
    p = pairs(spark, sf)
    r = D.diff_rows(p)
    side = lambda no, line: F.transform(F.array_sort(F.collect_list(F.when(F.col(no).isNotNull(), F.struct(no, line)))), lambda s: s[line])
    back = r.groupBy("pair_id").agg(side("left_no", "old_line").alias("o"), side("right_no", "new_line").alias("n"))
    return back.join(p, "pair_id").select("pair_id", (F.col("o") == F.col("old")).alias("old_back"), (F.col("n") == F.col("new")).alias("new_back"))


def moves_one_to_one(spark, sf):
    """Every move has one line on either side."""
    r = D.diff_rows(pairs(spark, sf)).where("move_pair is not null")
    g = r.groupBy("pair_id", "move_pair").agg(F.count(F.when(F.col("kind") == "moved-out", 1)).alias("o"), F.count(F.when(F.col("kind") == "moved-in", 1)).alias("i"))
    return g.groupBy((F.col("o") == 1).alias("one_out"), (F.col("i") == 1).alias("one_in")).agg(F.lit(True).alias("seen"))


def row_languages(spark, sf):
    """Languages of a file's blocks beside the file's own, where they differ."""
    f = table(spark, sf, "doc_files").select("file_id", "language")
    b = table(spark, sf, "blocks").select("file_id", F.lower(F.substring("language", 1, 2)).alias("block_language")).where("block_language is not null and block_language <> ''").distinct()
    return b.join(f, "file_id").where("language is not null and block_language <> language").select("file_id", "language", "block_language")


def changed_words(spark, sf):
    """Words of inserted and deleted spans per file, with the files' paths."""
    s = table(spark, sf, "change_spans").where("kind in ('insertion', 'deletion')").select("span_id", "file_id", "kind", F.size(X.words(F.coalesce("text", F.lit("")))).alias("w")).distinct()
    g = s.groupBy("file_id").agg(big(F.sum(F.when(F.col("kind") == "insertion", F.col("w")).otherwise(0))).alias("added"), big(F.sum(F.when(F.col("kind") == "deletion", F.col("w")).otherwise(0))).alias("removed"))
    return g.join(table(spark, sf, "doc_files").select("file_id", "path"), "file_id").select("path", "added", "removed")


QUERIES = {f.__name__: f for f in (review_rows, reference_texts, language_tags, language_names, durations, counted_files, alignment_rebuilds, moves_one_to_one, row_languages, changed_words)}
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())
SQL = {
    "review_rows": f"WITH {LINES_SQL} SELECT doc_id, idx + 1 AS right_no, 'equal' AS kind, CAST(NULL AS BIGINT) AS left_no FROM lines",
    "reference_texts": "WITH b AS (SELECT DISTINCT block_id, file_id, text FROM blocks WHERE text IS NOT NULL), c AS (SELECT *, coalesce(sum(len(text) + 1) OVER (PARTITION BY file_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT file_id, string_agg(left(text, CAST(200000 - before AS BIGINT)), chr(10) ORDER BY block_id) AS reference FROM c WHERE before < 200000 GROUP BY file_id",
    "language_tags": """WITH p AS (SELECT block_id, language, lower(regexp_extract(language, '^([A-Za-z]{2,3})(?:[-_]|$)', 1)) AS base, upper(regexp_extract(language, '^[A-Za-z]{2,3}[-_]([A-Za-z]{2})$', 1)) AS region FROM blocks)
SELECT language, CASE WHEN language IS NULL OR base = '' OR base IN ('und', 'zxx', 'non') THEN NULL WHEN region <> '' THEN base || '-' || region ELSE base END AS tag, count(DISTINCT block_id) AS blocks FROM p GROUP BY 1, 2""",
    "language_names": f"SELECT coalesce(CASE lang {_NAMES} END, lang, 'unknown') AS name, count(*) AS documents FROM documents GROUP BY 1",
    "durations": "WITH h AS (SELECT DISTINCT run_id, CAST(floor(seconds + 0.5) AS BIGINT) AS s FROM assess_history WHERE seconds >= 0 AND NOT isnan(seconds)) SELECT run_id, CASE WHEN s < 60 THEN s || ' s' ELSE (s // 60) || ' min ' || (s % 60) || ' s' END AS duration FROM h",
    "counted_files": "SELECT file_format, count(*) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END AS wording FROM doc_files GROUP BY file_format",
    "alignment_rebuilds": f"WITH {LINES_SQL} {NEW_SQL}, o AS (SELECT doc_id, list(line ORDER BY idx) AS l FROM lines GROUP BY 1), n AS (SELECT doc_id, list(line ORDER BY idx) AS l FROM newlines GROUP BY 1) SELECT o.doc_id AS pair_id, true AS old_back, true AS new_back FROM o LEFT JOIN n ON n.doc_id = o.doc_id WHERE o.l IS DISTINCT FROM n.l",
    "moves_one_to_one": "SELECT true AS one_out, true AS one_in, true AS seen",
    "row_languages": "SELECT DISTINCT b.file_id, f.language, lower(left(b.language, 2)) AS block_language FROM blocks b JOIN doc_files f ON f.file_id = b.file_id WHERE b.language <> '' AND f.language <> lower(left(b.language, 2))",
    "changed_words": r"WITH s AS (SELECT DISTINCT span_id, file_id, kind, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS w FROM change_spans WHERE kind IN ('insertion', 'deletion')) SELECT path, CAST(sum(CASE WHEN kind = 'insertion' THEN w ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN kind = 'deletion' THEN w ELSE 0 END) AS BIGINT) AS removed FROM s JOIN doc_files f ON f.file_id = s.file_id GROUP BY path",
}
