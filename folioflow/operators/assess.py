"""Assessments by a model: prompts as columns, an injected runner, answers parsed natively.

The runner ``prompt -> answer`` is the caller's; nothing here talks to a network. A runner
that fails gives the failure as ``error`` and never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions.text import cut

LIMIT = 300_000  # characters of a document
TASKS = {
    "value": "Say whether the changes improve the text, and give a verdict.",
    "writing": "Say how the new text reads and whether a person seems to have written it.",
    "citations": "Say which of the citations that were added look doubtful.",
    "review": "Name the problems of the text and what to do about them.",
}


def prompt(kind: Column, subject: Column, document: Column, references: Column | None = None, instructions: Column | None = None, limit: int = LIMIT, task: Column | None = None) -> Column:
    """Task (the kind's, if none is given), subject, instructions, references and the document, cut to the limit."""
    if task is None:
        tasks = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])
        task = F.coalesce(F.try_element_at(tasks, kind), F.lit(TASKS["review"]))
    parts = [task, F.concat(F.lit("Subject: "), subject)]
    parts += [F.when(F.trim(c) != "", F.concat(F.lit(f"{name}:\n"), c)) for name, c in (("Instructions", instructions), ("References", references)) if c is not None]
    return F.concat_ws("\n\n", *parts, cut(document, limit, "document"))


def assess(prompts: DataFrame, runner: Callable[[str], str], key: str = "id", text: str = "prompt") -> DataFrame:
    """``(key, markdown, error)`` of every prompt."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b[key], b[text], strict=True):
                try:
                    rows.append((k, runner(p or ""), None))
                except Exception as e:
                    rows.append((k, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=[key, "markdown", "error"])

    return prompts.select(key, text).mapInPandas(run, f"{key} {kind}, markdown string, error string")


#: Runners by name, ``(prompt, model) -> answer``; the caller registers what it may call.
BACKENDS: dict[str, Callable[[str, str | None], str]] = {}


def register_backend(name: str, runner: Callable[[str, str | None], str]) -> None:
    if not name or ":" in name:
        raise ValueError("a backend's name has no colon")
    BACKENDS[name] = runner


def backend(spec: str) -> Callable[[str], str]:
    """The runner of ``name`` or ``name:model``."""
    name, _, model = spec.partition(":")
    if name not in BACKENDS:
        raise ValueError(f"no such backend: {name}; known: {', '.join(sorted(BACKENDS)) or 'none'}")
    run = BACKENDS[name]
    return lambda text: run(text, model or None)


def comparison_prompts(rows: DataFrame, kind: str = "value", limit: int = LIMIT) -> DataFrame:
    """``(pair_id, prompt)``: the changes of each pair word by word and the new version, each cut to the limit."""
    from folioflow.operators.diff import word_lines
    from folioflow.sources.sinks import new_version

    lines = word_lines(rows.where("kind <> 'equal'")).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("l"))
    changes = lines.select("pair_id", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("changes"))
    both = changes.join(new_version(rows), "pair_id", "left")
    parts = F.concat(F.lit("Changes:\n"), cut(F.col("changes"), limit, "changes"), F.lit("\n\nNew version:\n"), cut(F.coalesce("text", F.lit("")), limit, "new version"))
    return both.select("pair_id", prompt(F.lit(kind), F.col("pair_id").cast("string"), parts, limit=3 * limit).alias("prompt"))


def assess_comparison(rows: DataFrame, runner: Callable[[str], str], kind: str = "value") -> DataFrame:
    """``(pair_id, markdown, error)`` of each pair with changes."""
    return assess(comparison_prompts(rows, kind), runner, "pair_id")


def apply_fixes(texts: DataFrame, fixes: DataFrame) -> DataFrame:
    """``texts(key, text)`` and ``fixes(key, start, replacement)`` → ``(key, text, applied)``: each quotation
    ``start`` replaced where it is found, line by line; of overlapping fixes the first counts. What can't be
    found is left out."""
    from folioflow.kernels.prose import with_fixes

    g = fixes.where("start <> '' and replacement is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "replacement"))).alias("fixes"))
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, asked in zip(b["key"], b["text"], b["fixes"], strict=True):
                places = [(at, at + len(f["start"]), f["replacement"]) for f in (asked if asked is not None else ()) if text and (at := text.find(f["start"])) >= 0]
                fixed = with_fixes(text, places) if places else text
                out.append((key, fixed, len(places)))
            yield pd.DataFrame(out, columns=["key", "text", "applied"])

    return texts.select("key", "text").join(g, "key", "left").mapInPandas(run, f"key {kind}, text string, applied bigint")


def context_conflicts(analysed: DataFrame, context: DataFrame) -> DataFrame:
    """``(path)`` of the files given as context that are analysed themselves, or lie in a folder that is:
    both sides are ``(path)``; folders end with a slash. Case and a leading ``./`` do not matter."""
    plain = F.regexp_replace(F.lower("path"), r"^(?:\./)+", "")
    a = analysed.select(plain.alias("_a")).distinct()
    # every folder above a file is a key of its own, so that this stays an equi-join
    parts = F.split("_c", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.when(k == F.size(parts), F.col("_c")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    c = context.select("path", plain.alias("_c")).select("path", F.explode(above).alias("_a"))
    return c.join(a, "_a", "left_semi").select("path").distinct()
