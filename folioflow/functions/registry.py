"""Measures and kernels by name: own measures of likeness, and functions for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from folioflow.kernels.lines import MEASURES, move_score, similarity_tokens, token_similarity
from folioflow.kernels.words import marked_html, word_line


def register_measure(name: str, measure: Callable[[list[str], list[str]], float]) -> None:
    """A measure of two token lists from 0 to 1, to be named in ``MoveSettings.algorithm``. The process that
    runs the kernels must have registered it too, as an import of the module that does so."""
    if not name.isidentifier() and "-" not in name:
        raise ValueError("a measure's name is letters, digits, hyphens")
    MEASURES[name] = measure


def _pairs(kind: str, of: Callable):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64" if kind == "double" else "object")

    return F.pandas_udf(run, kind)


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the kernels SQL functions of two strings, null where one is: ``token_sort``, ``token_set``
    and other measures, ``ordered_similarity``, ``line_move_score``, ``word_line``, ``old_html``, ``new_html``."""
    by = {m.replace("-", "_"): ("double", lambda x, y, f=f: f(similarity_tokens(x), similarity_tokens(y))) for m, f in MEASURES.items()}
    by |= {
        "ordered_similarity": ("double", lambda x, y: token_similarity(similarity_tokens(x), similarity_tokens(y))), "line_move_score": ("double", lambda x, y: move_score(x, y, 0.7)),
        "word_line": ("string", word_line), "old_html": ("string", lambda x, y: marked_html(x, y)[0]), "new_html": ("string", lambda x, y: marked_html(x, y)[1]),
    }
    for name, (kind, of) in by.items():
        spark.udf.register(prefix + name, _pairs(kind, of))
    return sorted(prefix + n for n in by)
