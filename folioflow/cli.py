"""``python -m folioflow.cli OLD NEW``: compare two files, folders or commits; ``review FILE`` shows one."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields
from pathlib import Path

from folioflow.config import MoveSettings, Options, PassageSettings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow", description="Compare two versions of texts.")
    p.add_argument("old", help="a file, a folder, a commit with --git, or 'review'")
    p.add_argument("new", help="the other side, or the file to review")
    p.add_argument("--git", metavar="REPOSITORY", help="compare two commits (or INDEX) of a repository")
    p.add_argument("--format", choices=("unified", "words", "counts", "html", "panel", "text"), default="unified")
    p.add_argument("--output", help="a folder for one file a pair, instead of standard output")
    p.add_argument("--context", type=int, help="unchanged rows around changes")
    p.add_argument("--full", action="store_true", help="all rows")
    p.add_argument("--max-hidden", type=int, default=500, help="longer gaps are left out whole")
    p.add_argument("--split", choices=("paragraph", "sentence"), default="paragraph")
    p.add_argument("--similarity", type=float, help="from which on lines count as moved")
    p.add_argument("--algorithm", choices=("token-sort", "token-set"), default="token-sort")
    p.add_argument("--no-passages", action="store_true")
    p.add_argument("--ignore-whitespace", action="store_true")
    p.add_argument("--comments", choices=("markers", "text", "none"), default="markers")
    p.add_argument("--empty-comments", action="store_true")
    p.add_argument("--resolved", action="store_true", help="resolved comments too")
    p.add_argument("--changes", choices=("accept-all", "reject-all", "show"), default="accept-all")
    p.add_argument("--language", default="guess", help="a tag, or: document, guess, default")
    p.add_argument("--encoding")
    p.add_argument("--include", help="globs separated by |")
    p.add_argument("--path", action="append", default=[], help="a file or folder below both sides, repeatable")
    p.add_argument("--common-only", action="store_true")
    p.add_argument("--no-renames", action="store_true")
    for f in fields(PassageSettings):
        p.add_argument(f"--passage-{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    return p


def options_of(a: argparse.Namespace) -> Options:
    passages = PassageSettings(**{f.name: getattr(a, f"passage_{f.name}") for f in fields(PassageSettings)})
    moves = MoveSettings(a.similarity or 0.7, a.algorithm)
    return Options(
        context=10**9 if a.full else a.context, max_hidden=a.max_hidden, by_sentence=a.split == "sentence", ignore_whitespace=a.ignore_whitespace, comments=a.comments, empty_comments=a.empty_comments, skip_resolved=not a.resolved,
        changes=a.changes, move_passages=not a.no_passages, paragraph_moves=moves, sentence_moves=MoveSettings(a.similarity or 0.55, a.algorithm), passages=passages, language=a.language, encoding=a.encoding,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        options = options_of(a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    review = a.old == "review" and not a.git
    if not a.git and not all(Path(x).exists() for x in ([a.new] if review else [a.old, a.new])):
        print("both sides must exist", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession, functions as F

    from folioflow.operators import compare as C, diff as D
    from folioflow.sources import sinks
    from folioflow.sources.files import read_folder

    spark = SparkSession.builder.getOrCreate()

    def side(where: str):
        if a.git:
            return C.read_git(spark, a.git, where)
        if Path(where).is_file():
            name = Path(a.new).name  # two files are one pair under one name
            return spark.read.format("binaryFile").load(where).select(F.lit(name).alias("path"), "content")
        return read_folder(spark, where, a.include, a.path).select("path", "content")

    new = side(a.new)
    pairs = C.file_pairs(new.limit(0) if review else side(a.old), new, a.common_only, not a.no_renames)
    done = C.compared(pairs, options).cache()
    rows = C.rows_of(done)
    for r in done.where("error is not null").select("pair_id", "error").toLocalIterator():
        print(f"{r['pair_id']}: {r['error']}", file=sys.stderr)
    if a.format == "counts":
        D.counts(rows).orderBy("pair_id").show(1000, False)
        return 0
    if a.format == "panel":
        C.panel_of(done).orderBy("pair_id", "label").show(1000, False)
        return 0
    if a.format == "words":
        lines = D.word_lines(rows).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("l"))
        out, col, suffix = lines.select("pair_id", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("t")), "t", ".words"
    elif a.format == "html":
        out, col, suffix = sinks.html_report(D.folded(rows, options.context_for(), options.max_hidden)), "html", ".html"
    elif a.format == "text":
        out, col, suffix = sinks.new_version(rows), "text", ".txt"
    else:
        out, col, suffix = sinks.unified(rows, 3 if options.context is None else options.context), "diff", ".diff"
    if a.output:
        for r in sinks.write_files(out, a.output, col, suffix).toLocalIterator():
            print(r["path"])
        return 0
    for r in out.orderBy("pair_id").toLocalIterator():
        print(f"--- {r['pair_id']}\n+++ {r['pair_id']}\n{r[col]}" if a.format == "unified" else r[col])
    return 0


if __name__ == "__main__":
    sys.exit(main())
