"""Similar lines within a pair of versions: exact multiset-overlap joins.

Two lines' token-sort similarity is twice their shared tokens (as multisets) over all their
tokens. A pair at threshold ``t`` shares a token among the rarest of either side: of ``n``
tokens those beyond the ``ceil(t n / (2 - t))`` that must be shared. Only those are joined
(prefix filter, no pair is lost), by hashes of tokens: two of one hash only add candidates.
Lengths out of reach are dropped, and the candidates' scores come from intersections of the
numbered tokens themselves, all in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.functions.text import similarity_tokens
from folioflow.session import cut_lineage, unsent

TOLERANCE = 1e-9


def token_counts(lines: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """``keys, token, c``: how often each token occurs in each line."""
    return lines.select(*keys, F.explode(similarity_tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("c"))


def similar_lines(old: DataFrame, new: DataFrame, group: str, threshold: float) -> DataFrame:
    """``old(group, i, line)`` and ``new(group, j, line)`` → ``(group, i, j, score)`` of the pairs
    within a group at or over the threshold. Lines without tokens are in no pair."""
    def sides() -> DataFrame:
        """Both sides' lines as sorted arrays of (token, copies), made once."""
        o = old.select(group, F.lit(0).alias("side"), F.col("i").alias("line_id"), F.col("line"))
        n = new.select(group, F.lit(1).alias("side"), F.col("j").alias("line_id"), F.col("line"))
        # no filter on the tokens, which would be made once more for it; a line without any is in no pair below
        d = o.union(n).select(group, "side", "line_id", F.array_sort(similarity_tokens(F.col("line"))).alias("t"))
        # the k-th copy of a token carries k, so that sets stand for multisets: its place less the place of the first copy
        numbered = F.transform("t", lambda x, k: F.concat(x, F.lit("\x01"), (k - F.array_position("t", x).cast("int") + 2).cast("string")))
        return d.select(group, "side", "line_id", numbered.alias("t"), F.size("t").alias("n"))

    lines = cut_lineage(sides())
    each = lines.select(group, "side", "line_id", "n", F.explode("t").alias("token")).withColumn("token", F.xxhash64("token"))
    # a token of one side only is in no intersection: it counts as rarer than any other and goes no further
    token = W.partitionBy(group, "token")
    shared = each.withColumns({"df": F.count("*").over(token), "_lo": F.min("side").over(token), "_hi": F.max("side").over(token)}).where("_lo < _hi")
    line = W.partitionBy(group, "side", "line_id")
    need = F.ceil(F.lit(threshold) * F.col("n") / (2 - threshold) - TOLERANCE)
    prefix = shared.withColumns({"_r": F.row_number().over(line.orderBy("df", "token")), "_of": F.count("*").over(line)}).where(F.col("_r") <= F.col("_of") - need + 1)
    prefix = cut_lineage(prefix.select(group, "side", "token", "line_id", "n"))
    a = prefix.where("side = 0").select(group, "token", F.col("line_id").alias("i"), F.col("n").alias("n_i"))
    b = prefix.where("side = 1").select(group, "token", F.col("line_id").alias("j"), F.col("n").alias("n_j"))
    lo, hi = F.least("n_i", "n_j"), F.greatest("n_i", "n_j")
    cand = a.join(unsent(b), [group, "token"]).where(lo >= F.lit(threshold) * hi / (2 - threshold) - TOLERANCE).select(group, "i", "j", "n_i", "n_j").distinct()
    of = lambda side, key, name: lines.where(F.col("side") == side).select(group, F.col("line_id").alias(key), F.col("t").alias(name))
    scored = cand.join(unsent(of(0, "i", "ta")), [group, "i"]).join(unsent(of(1, "j", "tb")), [group, "j"])
    scored = scored.withColumn("score", 2.0 * F.size(F.array_intersect("ta", "tb")) / (F.col("n_i") + F.col("n_j")))
    return scored.where(F.col("score") >= threshold - TOLERANCE).select(group, "i", "j", "score")


def rare_word_candidates(old: DataFrame, new: DataFrame, group: str, rare_min: int = 20, rare_share: float = 0.01, most: int = 250_000) -> DataFrame:
    """Passage pairs sharing rare words: ``(group, i, j, shared)``, the ``most`` best of a group.

    ``old(group, i, words)`` and ``new(group, j, words)`` hold each passage's words; a word is
    rare if at most ``max(rare_min, rare_share * passages)`` passages of the group have it. The
    cut is part of the operator: ties fall by ``(shared desc, i, j)``."""
    a = old.select(group, "i", F.explode(F.array_distinct("words")).alias("word"))
    b = new.select(group, "j", F.explode(F.array_distinct("words")).alias("word"))
    passages = old.groupBy(group).agg(F.count("*").alias("n")).union(new.groupBy(group).agg(F.count("*").alias("n"))).groupBy(group).agg(F.sum("n").alias("n"))
    df = a.select(group, "word").union(b.select(group, "word")).groupBy(group, "word").agg(F.count("*").alias("df"))
    rare = df.join(passages, group).where(F.col("df") <= F.greatest(F.lit(float(rare_min)), F.col("n") * rare_share)).select(group, "word")
    pairs = a.join(rare, [group, "word"]).join(b, [group, "word"]).groupBy(group, "i", "j").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("shared"), "i", "j"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def mutual_best(pairs: DataFrame, group: str) -> DataFrame:
    """One-to-one matching by falling score, ties by ``(i, j)``: the greedy matching, complete.

    Each group is read once in that order, sorted by Spark; only the numbers taken are kept in
    memory. A group is one task, as it is one pair of versions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right = None, set(), set()
        for t in batches:
            keep = []
            for g, i, j in zip(*(t.column(c).to_pylist() for c in (group, "i", "j")), strict=True):
                if at != (g,):
                    at, left, right = (g,), set(), set()
                keep.append(i not in left and j not in right)
                if keep[-1]:
                    left.add(i)
                    right.add(j)
            yield t.filter(pa.array(keep, pa.bool_()))

    return pairs.repartition(group).sortWithinPartitions(group, F.desc("score"), "i", "j").mapInArrow(run, pairs.schema)
