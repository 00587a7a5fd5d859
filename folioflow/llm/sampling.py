"""Bounded samples of documents for training: the ids first, then the few texts.

A sample is chosen by a hash of the id below a threshold that follows from the row count, so
each executor sends only rows of the sample, whatever the table's size. Equal texts count once.
The limit on top only holds where ids repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SAMPLE_DOCS, SAMPLE_CHARS = 4000, 20_000  # rows, characters a row
SPARE = 1.25  # rows asked for beyond the wanted ones, as a hash is not exact


def sample_documents(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, key: str = "doc_id") -> list[tuple[str | None, str]]:
    """(language mark, text) of at most ``docs`` documents of 1 to ``chars`` characters, the same ones every time."""
    n = documents.count()
    span = 1 << 31
    low = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(span))
    picked = documents if n <= docs else documents.where(low < int(span * min(1.0, SPARE * docs / n)))
    rows = picked.where(F.length("text").between(1, chars)).select(low.alias("h"), key, F.col("lang"), "text").limit(int(2 * SPARE * docs)).collect()
    out: dict[str, str | None] = {}
    for r in sorted(rows, key=lambda r: (r["h"], str(r[key]))):
        out.setdefault(r["text"], r["lang"])
    return [(lang, text) for text, lang in list(out.items())[:docs]]
