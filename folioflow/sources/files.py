"""Reading folders, documents and text of unknown encoding into DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions.text import in_paths, included, suffix_of
from folioflow.kernels.documents import DocumentError, document_kind, read_docx, read_odt
from folioflow.kernels.encodings import decode_text, is_binary

LOCKS = r"(^|/)(~\$[^/]*|\.~lock\.[^/]*#)$"
def list_folder(spark: SparkSession, path: str, include: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """``(path, modificationTime, length)`` of a folder's files by their path below it, without lock
    files and what lies in ``.git``; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    d = raw.withColumn("path", F.substring_index("path", path.rstrip("/") + "/", -1))
    return d.where(~F.col("path").rlike(LOCKS) & ~F.col("path").rlike(r"(^|/)\.git/") & included(F.col("path"), include) & in_paths(F.col("path"), paths or []))


def read_folder(spark: SparkSession, path: str, include: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """``(path, content, modificationTime, length)`` of the files of ``list_folder``. A single pattern of a
    name reaches the scan, and so do the folders or files of ``paths``; other filters follow the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    root = path.rstrip("/")
    if include and "|" not in include and "/" not in include:  # the scan's patterns mind case, ours do not
        reader = reader.option("pathGlobFilter", "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in include))
    d = reader.load([f"{root}/{p}" for p in paths] if paths else root).withColumn("path", F.substring_index("path", root + "/", -1))
    d = d.where(~F.col("path").rlike(LOCKS) & ~F.col("path").rlike(r"(^|/)\.git/") & included(F.col("path"), include) & in_paths(F.col("path"), paths or []))
    return d.select("path", "content", "modificationTime", "length")


def describe_files(files: DataFrame) -> DataFrame:
    """``(path, name, kind, changed)`` of listed files: the name alone, what kind of file its suffix says, and the minute of its last change."""
    suffix = suffix_of(F.col("path"))
    kind = F.when(suffix == ".docx", "Word").when(suffix == ".odt", "OpenDocument").when(suffix.isin(".md", ".markdown", ".qmd", ".rmd"), "Markdown").otherwise("text")
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), kind.alias("kind"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm").alias("changed"))


def read_texts(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """``files(path, content)`` → ``(path, text, read_as, binary)``; a NUL in the first 8,000 bytes
    makes a file binary, without text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                data = bytes(data or b"")
                if is_binary(data):
                    rows.append((path, None, None, True))
                else:
                    rows.append((path, *decode_text(data, encoding), False))
            yield pd.DataFrame(rows, columns=["path", "text", "read_as", "binary"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, read_as string, binary boolean")


def read_documents(files: DataFrame, changes: str = "accept-all", skip_resolved: bool = True) -> DataFrame:
    """Blocks of Word and OpenDocument files; a file that can't be read gives one row with ``error``."""
    schema = "path string, number bigint, kind string, level int, text string, styles array<struct<start:int,end:int,style:string>>, comments array<struct<author:string,text:string,date:string,resolved:boolean>>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                data = bytes(data or b"")
                try:
                    kind = document_kind(data)
                    if kind is None:
                        raise DocumentError("neither a Word nor an OpenDocument text")
                    doc = (read_docx if kind == "docx" else read_odt)(data, changes, skip_resolved)
                    notes = [{"author": a, "text": t, "date": d, "resolved": r} for a, t, d, r in doc.comments]
                    rows += [(path, n, x.kind, x.level, x.text, [{"start": s, "end": e, "style": k} for s, e, k in x.styles], notes if n == 0 else [], None) for n, x in enumerate(doc.blocks)]
                except Exception as e:  # one bad file must not fail the job
                    rows.append((path, None, None, None, None, [], [], str(e) or type(e).__name__))
            out = pd.DataFrame(rows, columns=["path", "number", "kind", "level", "text", "styles", "comments", "error"])
            out["number"], out["level"] = out["number"].astype("Int64"), out["level"].astype("Int32")
            yield out

    return files.where(suffix_of(F.col("path")).isin(".docx", ".odt")).select("path", "content").mapInPandas(run, schema)


def run_filter(texts: DataFrame, command: str, seconds: int = 300) -> DataFrame:
    """``texts(path, text)`` piped one by one through a shell command on the executors, by the
    caller's own choice; a command that fails or takes too long gives ``error``."""
    import subprocess

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    p = subprocess.run(command, shell=True, input=text or "", capture_output=True, text=True, timeout=seconds, start_new_session=True)
                    rows.append((path, p.stdout, None) if p.returncode == 0 else (path, None, p.stderr.strip()[:500] or f"exit status {p.returncode}"))
                except subprocess.TimeoutExpired:
                    rows.append((path, None, f"took more than {seconds} s"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return texts.select("path", "text").mapInPandas(run, "path string, text string, error string")
