"""Text sizes in tokens of a public byte-level BPE vocabulary.

The vocabulary file is a parameter (``FOLIOFLOW_TOKENIZER`` or an argument); nothing is
copied or trained here. Null and empty texts have 0 tokens; special strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_loaded: dict[str, object] = {}


def vocabulary_path(path: str | None = None) -> str:
    if path or (path := os.environ.get("FOLIOFLOW_TOKENIZER")):
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` columns and ``tokens bigint``, the text itself is dropped after counting."""
    path = vocabulary_path(path)
    df.sparkSession.sparkContext.addFile(path)  # workers need not see the driver's folders
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        shipped = SparkFiles.get(os.path.basename(path))
        enc = encoding(shipped if os.path.exists(shipped) else path)
        for b in batches:
            texts = b["_text"].fillna("").tolist()
            out = b[keep].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) for t in texts]
            yield out

    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(count, schema)
