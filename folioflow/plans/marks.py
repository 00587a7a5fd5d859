"""Queries on comments, notes, sentences and styles within documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.kernels import prose as K
from folioflow.kernels.moves import compare
from folioflow.kernels.redline import tracked_docx, tracked_odt
from folioflow.plans.prose import LINES_SQL, lines
from folioflow.plans.versions import pairs
from folioflow.session import table
from folioflow.sources.files import read_documents


def _each(d: DataFrame, columns: list[str], schema: str, rows: Callable) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for x in b.itertuples(index=False, name=None) for r in rows(*x)], columns=names)

    return d.select(*columns).mapInPandas(run, schema)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null")


def comment_folding(spark, sf):
    """Comments written into documents, each different one once a document."""
    return _each(_texts(spark, sf), ["doc_id", "text"], "doc_id bigint, place bigint, author string, comment string, date string", lambda d, t: [(d, n, *c) for n, c in enumerate(K.fold_comments(t)[1])])


def sentence_lines(spark, sf):
    """Lines split into sentences by the rules for Markdown."""
    return _each(_texts(spark, sf), ["doc_id", "text"], "doc_id bigint, label string, sentence string", lambda d, t: [(d, *x) for x in K.split_sentences(t.split("\n"))])


def footnote_match(spark, sf):
    """Notes of each file against the same notes under other numbers (a + put after each)."""
    n = table(spark, sf, "blocks").where("kind = 'note' and text is not null").select("file_id", "block_id", "text").dropDuplicates(["block_id"])
    g = n.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "text"))).alias("x"))
    old = F.transform("x", lambda s: s["text"])
    new = F.transform(old, lambda t: F.regexp_replace(t, r"^(\[\^[^\]\s]+)\]:", "$1+]:"))
    return _each(g.select("file_id", old.alias("old"), new.alias("new")), ["file_id", "old", "new"], "file_id bigint, old_label string, new_label string", lambda p, o, n: [(p, *x) for x in K.match_footnotes(list(o), list(n)).items()])


def md_style_runs(spark, sf):
    return _each(_texts(spark, sf), ["doc_id", "text"], "doc_id bigint, line bigint, start bigint, stop bigint, style string", lambda d, t: [(d, k, *x) for k, line in enumerate(t.split("\n")) for x in K.md_styles(line)])


def tracked_round_trip(spark, sf):
    """Tracked-change files of every document's revision: whether accepting gives the new and
    rejecting the old text, as Word and as OpenDocument."""

    def files(p, old, new):
        old, new = ([x.strip() or "-" for x in (" ".join(line.split()) for line in side)] for side in (old, new))
        rows = compare(old, new)
        return [(f"{p}.docx", tracked_docx(rows, old, new), "\n".join(old), "\n".join(new)), (f"{p}.odt", tracked_odt(rows, old, new), "\n".join(old), "\n".join(new))]

    f = _each(pairs(spark, sf), ["pair_id", "old", "new"], "path string, content binary, old string, new string", files)
    read = lambda how: read_documents(f, how).where("text <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("l")).select("path", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias(how.replace("-", "_")))
    j = f.select("path", "old", "new").join(read("accept-all"), "path", "left").join(read("reject-all"), "path", "left")
    same = lambda a, b: F.coalesce(a, F.lit("")) == b
    return j.select("path", same(F.col("accept_all"), F.col("new")).alias("accepted"), same(F.col("reject_all"), F.col("old")).alias("rejected"))


def known_comments(spark, sf):
    """A comment for every line of every document, with brackets, braces and quotes in all parts: what is folded out."""
    w = lambda k: F.substring("h", k, 8)
    h = F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("idx").cast("string")).cast("binary"))
    n = F.col("idx").cast("string")
    said = F.concat(w(1), F.lit(" ["), w(9), F.lit(" [see "), w(17), F.lit(']]{.comment-start id="'), n, F.lit('" author="Ann \\"'), w(25), F.lit('\\" {x}" date="2020-01-01T10:00:00Z"} word[]{.comment-end id="'), n, F.lit('"}'))
    d = lines(spark, sf).withColumn("h", h).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", said.alias("t")))).alias("x"))
    d = d.select("doc_id", F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("text"))

    def rows(doc, text):
        plain, notes = K.fold_comments(text)
        return [(doc, n, *c, K.remove_marks(line)) for n, (c, line) in enumerate(zip(notes, plain.split("\n"), strict=True))]

    return _each(d, ["doc_id", "text"], "doc_id bigint, place bigint, author string, comment string, date string, plain string", rows)


def known_sentences(spark, sf):
    """Every line as a list item of three sentences between a front matter and a fence, which stay whole."""
    w = lambda k: F.substring("h", k, 8)
    h = F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("idx").cast("string")).cast("binary"))
    said = F.concat(F.lit("- One "), w(1), F.lit(". Two "), w(9), F.lit("![^3] Three "), w(17), F.lit(" e.g. ends"))
    d = lines(spark, sf).withColumn("h", h).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", said.alias("t")))).alias("x"))
    d = d.select("doc_id", F.concat(F.lit("---\ntitle: A. B.\n---\n"), F.array_join(F.transform("x", lambda s: s["t"]), "\n"), F.lit("\n```\nx. Y. z\n```")).alias("text"))
    return _each(d, ["doc_id", "text"], "doc_id bigint, label string, sentence string", lambda d, t: [(d, *x) for x in K.split_sentences(t.split("\n"), "en")])


QUERIES = {f.__name__: f for f in (comment_folding, known_comments, sentence_lines, known_sentences, footnote_match, md_style_runs, tracked_round_trip)}
SQL = {
    "footnote_match": r"""SELECT DISTINCT file_id, regexp_extract(text, '^\[\^([^\]\s]+)\]:', 1) AS old_label, regexp_extract(text, '^\[\^([^\]\s]+)\]:', 1) || '+' AS new_label
FROM blocks WHERE kind = 'note' AND regexp_matches(text, '^\[\^([^\]\s]+)\]:')""",
    "tracked_round_trip": "SELECT doc_id || s AS path, true AS accepted, true AS rejected FROM documents, (VALUES ('.docx'), ('.odt')) f(s) WHERE text IS NOT NULL",
    "known_comments": f"""WITH {LINES_SQL}, m AS (SELECT doc_id, idx, md5(doc_id || '/' || idx) AS h FROM lines)
SELECT doc_id, idx AS place, 'Ann "' || substr(h, 25, 8) || '" {{x}}' AS author, substr(h, 9, 8) || ' [see ' || substr(h, 17, 8) || ']' AS comment, '2020-01-01T10:00:00Z' AS date, substr(h, 1, 8) || ' word' AS plain FROM m""",
    "known_sentences": f"""WITH {LINES_SQL}, m AS (SELECT doc_id, idx, md5(doc_id || '/' || idx) AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM lines),
s AS (SELECT doc_id, idx + 4 AS line, unnest([1, 2, 3]) AS k, unnest(['- One ' || substr(h, 1, 8) || '.', '  Two ' || substr(h, 9, 8) || '![^3]', '  Three ' || substr(h, 17, 8) || ' e.g. ends']) AS sentence FROM m),
w AS (SELECT DISTINCT doc_id, n FROM m), f AS (SELECT doc_id, n, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest(['---', 'title: A. B.', '---', '```', 'x. Y. z', '```']) AS sentence FROM w)
SELECT doc_id, line || '.' || k AS label, sentence FROM s UNION ALL SELECT doc_id, CAST(CASE WHEN k <= 3 THEN k ELSE n + k END AS VARCHAR), sentence FROM f""",
}
