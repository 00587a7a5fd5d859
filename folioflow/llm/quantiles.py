"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch holds full sorted buffers of ``k`` values, at most one a level; a buffer of level
``l`` stands for ``2**l`` values each. Two buffers of one level collapse into one of the
next by taking every other value of their merged order, alternately from the odd and the
even positions. Values that do not fill a buffer stay as they are, with weight 1. Sketches
merge like binary numbers add, in a tree of bounded fan-in, so partitions, files and days
combine in any order.

Error: after ``C`` collapses whose results weigh ``W`` in all, and with the heaviest
buffer weighing ``w``, the rank of a reported value is off by at most
``(W - C - 1) / 2 + w`` (published for this family of collapsing schemes); the bound is
kept with each sketch and reported beside the percentiles.

Defined results: null and NaN are no values and are counted apart; zero, negative and
infinite numbers are values; groups without a value give null percentiles; null is a
group of its own in every group column; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

K = 2048
FAN_IN = 64
MOST_GROUPS = 20_000  # sketches a task holds at a time


def buffer_size(error: float, rows: int) -> int:
    """Size of the buffers that keeps the rank error of ``rows`` values below ``error`` times their number."""
    k = 16
    while (math.log2(max(2.0, rows / k)) + 1) / k > error:
        k *= 2
    return k


class Sketch:
    __slots__ = ("invalid", "k", "levels", "n", "rest", "flip", "collapsed", "collapses", "low", "high")

    def __init__(self, k: int = K):
        self.k, self.n, self.invalid = k, 0, 0
        self.rest: list[np.ndarray] = []
        self.levels: dict[int, np.ndarray] = {}
        self.flip, self.collapsed, self.collapses = 0, 0, 0
        self.low, self.high = math.inf, -math.inf

    def add(self, values: np.ndarray) -> Sketch:
        valid = values[~np.isnan(values)]
        self.invalid += len(values) - len(valid)
        if len(valid):
            self.n += len(valid)
            self.low, self.high = min(self.low, valid.min()), max(self.high, valid.max())
            self.rest.append(valid)
            self._fill()
        return self

    def _fill(self) -> None:
        if sum(map(len, self.rest)) < self.k:
            return
        rest = np.concatenate(self.rest)
        full = len(rest) // self.k
        for i in range(full):
            self._carry(0, np.sort(rest[i * self.k : (i + 1) * self.k]))
        self.rest = [rest[full * self.k :]] if len(rest) % self.k else []

    def _carry(self, level: int, buffer: np.ndarray) -> None:
        while (other := self.levels.pop(level, None)) is not None:
            both = np.concatenate([buffer, other])
            both.sort(kind="stable")
            buffer = both[self.flip :: 2]
            self.flip ^= 1
            level += 1
            self.collapsed += 1 << level
            self.collapses += 1
        self.levels[level] = buffer

    def merge(self, other: Sketch) -> Sketch:
        self.n, self.invalid = self.n + other.n, self.invalid + other.invalid
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.collapsed, self.collapses = self.collapsed + other.collapsed, self.collapses + other.collapses
        for level in sorted(other.levels):
            self._carry(level, other.levels[level])
        self.rest += other.rest
        self._fill()
        return self

    def rank_error(self) -> int:
        """Bound on how far, in ranks, a reported percentile may lie."""
        if not self.collapses:
            return 0
        return (self.collapsed - self.collapses - 1) // 2 + (1 << max(self.levels))

    def quantiles(self, at: Sequence[float]) -> list[float | None]:
        if not self.n:
            return [None] * len(at)
        parts = [(np.sort(np.concatenate(self.rest)), 1)] if self.rest else []
        parts += [(b, 1 << level) for level, b in self.levels.items()]
        values = np.concatenate([v for v, _ in parts])
        weights = np.concatenate([np.full(len(v), w, dtype=np.int64) for v, w in parts])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        out = []
        for q in at:
            if q <= 0 or q >= 1:
                out.append(float(self.low if q <= 0 else self.high))
            else:
                out.append(float(values[min(np.searchsorted(ranks, max(1, math.ceil(q * self.n))), len(values) - 1)]))
        return out

    def pack(self) -> bytes:
        rest = np.concatenate(self.rest) if self.rest else np.empty(0)
        head = struct.pack("<5q2dB2i", self.k, self.n, self.invalid, self.collapsed, self.collapses, self.low, self.high, self.flip, len(rest), len(self.levels))
        levels = sorted(self.levels)
        return head + np.array(levels, dtype="<i4").tobytes() + rest.astype("<f8").tobytes() + b"".join(self.levels[x].astype("<f8").tobytes() for x in levels)

    @staticmethod
    def unpack(data: bytes) -> Sketch:
        size = struct.calcsize("<5q2dB2i")
        s = Sketch()
        s.k, s.n, s.invalid, s.collapsed, s.collapses, s.low, s.high, s.flip, rest, levels = struct.unpack("<5q2dB2i", data[:size])
        names = np.frombuffer(data, "<i4", levels, size)
        at = size + 4 * levels
        if rest:
            s.rest = [np.frombuffer(data, "<f8", rest, at)]
        at += 8 * rest
        for x in names:
            s.levels[int(x)] = np.frombuffer(data, "<f8", s.k, at)
            at += 8 * s.k
        return s


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def build_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch per group: ``keys, sketch binary``.

    Every partition sketches its own rows, so a group's rows are never brought together;
    partial sketches then merge in rounds of at most about ``fan_in`` each.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(value).cast("double").alias("_value"), F.spark_partition_id().alias("_part"))
    partial = T.StructType([*_key_fields(df, keys), T.StructField("_part", T.IntegerType()), T.StructField("sketch", T.BinaryType())])

    def frame(kept: dict, part: int) -> pd.DataFrame:
        return pd.DataFrame([(*name, part, s.pack()) for name, s in kept.items()], columns=[*keys, "_part", "sketch"])

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, Sketch] = {}
        part = 0
        for b in batches:
            if b.empty:
                continue
            part = int(b["_part"].iloc[0])
            values = b["_value"].to_numpy(dtype="float64", na_value=np.nan)
            codes = np.zeros(len(b), dtype=np.int64)
            uniques = []
            for key in keys:
                c, u = pd.factorize(b[key], use_na_sentinel=False)
                codes = codes * len(u) + c
                uniques.append(list(u))
            order = np.argsort(codes, kind="stable")
            found, starts = np.unique(codes[order], return_index=True)
            for code, at in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                name = []
                for u in reversed(uniques):
                    code, i = divmod(code, len(u))
                    x = u[i]
                    name.append(None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x)
                kept.setdefault(tuple(reversed(name)), Sketch(k)).add(values[at])
                if len(kept) >= MOST_GROUPS:  # many groups: what there is goes out and is merged later
                    yield frame(kept, part)
                    kept = {}
        if kept:
            yield frame(kept, part)

    return merge_sketches(d.mapInPandas(partly, partial), keys, fan_in)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], fan_in: int = FAN_IN, parts: int | None = None) -> DataFrame:
    """Sketches of the same group become one, in a tree: first within salts, then across."""
    keys = list(keys)
    out = T.StructType([*_key_fields(sketches, keys), T.StructField("_part", T.IntegerType()), T.StructField("sketch", T.BinaryType())])
    if "_part" not in sketches.columns:
        sketches = sketches.withColumn("_part", F.pmod(F.xxhash64("sketch"), F.lit(1 << 20)).cast("int"))
    sketches = sketches.select(*keys, "_part", "sketch")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, first, whole = None, None, None
        for b in batches:
            done = []
            for row in b[[*keys, "_part", "sketch"]].itertuples(index=False, name=None):
                group = tuple(None if x is None or x is pd.NA or x != x else x for x in row[:-2])
                if whole is not None and group == name:
                    whole.merge(Sketch.unpack(row[-1]))
                    continue
                if whole is not None:
                    done.append((*name, first, whole.pack()))
                name, first, whole = group, row[-2], Sketch.unpack(row[-1])
            if done:
                yield pd.DataFrame(done, columns=[*keys, "_part", "sketch"])
        if whole is not None:
            yield pd.DataFrame([(*name, first, whole.pack())], columns=[*keys, "_part", "sketch"])

    for salts in (fan_in, 1):
        salted = sketches.withColumn("_salt", F.pmod("_part", F.lit(salts)))
        sketches = salted.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", "_part").drop("_salt").mapInPandas(join, out)
    return sketches.select(*keys, "sketch")


def read_quantiles(sketches: DataFrame, keys: Sequence[str], at: dict[str, float]) -> DataFrame:
    """``keys, n, n_invalid, lowest, highest, <a column per percentile>, rank_error``."""
    fields = [T.StructField("n", T.LongType()), T.StructField("n_invalid", T.LongType()), T.StructField("lowest", T.DoubleType()), T.StructField("highest", T.DoubleType())]
    fields += [T.StructField(name, T.DoubleType()) for name in at] + [T.StructField("rank_error", T.LongType())]
    schema = T.StructType([*_key_fields(sketches, keys), *fields])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data in b["sketch"]:
                s = Sketch.unpack(data)
                rows.append((s.n, s.invalid, *((s.low, s.high) if s.n else (None, None)), *s.quantiles(list(at.values())), s.rank_error()))
            out = pd.DataFrame(rows, columns=[f.name for f in fields], index=b.index)
            for name in ("lowest", "highest", *at):
                out[name] = out[name].astype("float64")
            yield pd.concat([b[list(keys)], out], axis=1)

    return sketches.select(*keys, "sketch").mapInPandas(read, schema)
