"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time ``t`` in 0..1: points ``(t, weight)`` with
straight lines between, level before the first and after the last. Only its course counts, as its
integral is scaled to the source's tokens in the mixture. The demand of a source up to ``t`` is
the integral up to there; inverting that for the middle of each record copy gives the copy's
training position, and the copies are range-sorted by position. Records are never cut.

A source without points of its own follows a ramp: sources that are repeated rise towards the
end, the others fall, so that the total stays level (``TILT`` is the steepest).

The budget defaults to the tokens of all records. A source gives at most its tokens times
``max_repeats``; what it falls short of is spread over the other sources by their target
shares, so the shares reached are as near to the targets as the caps allow. With
``budget="exact"`` the budget is the largest at which every source meets its target.

Running sums within a source go in two levels (buckets of a hash, then rows), so a source
with a third of all rows isn't one task.

Defined results: sources without a target (null included) are not used and are reported
with target 0; a target without records reaches 0; records of 0 tokens keep their place
in the order; repeated rows count as often as they occur; negative or null targets are 0;
points that are null or have a negative weight are ignored, of two at one time the higher counts,
and a schedule that is nowhere above 0 is none.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.session import cut_lineage, running

BUCKET_ROWS = 50_000
TILT = 0.5


def demands(supply: dict, target: dict, repeats: dict, budget: float) -> dict:
    """Tokens per source: target shares of the budget, capped, the rest spread over the others."""
    cap = {s: supply.get(s, 0) * max(0, repeats.get(s) or 0) for s in target}
    got, open_, left = {}, {s for s in target if target[s] > 0}, float(budget)
    while open_:
        weight = sum(target[s] for s in open_)
        full = {s for s in open_ if cap[s] <= left * target[s] / weight}
        if not full:
            got |= {s: left * target[s] / weight for s in open_}
            break
        got |= {s: float(cap[s]) for s in full}
        left -= sum(got[s] for s in full)
        open_ -= full
    return got | {s: 0.0 for s in target if s not in got}


def plan(records: DataFrame, targets: DataFrame, budget: float | str | None = None) -> list[tuple]:
    """``(source, target, repeats, supply, demand, tilt)`` per source; the number of sources with a target is bounded by the targets table."""
    named = {r["source"]: (max(0.0, r["target_share"] or 0.0), int(r["max_repeats"] or 0)) for r in targets.collect()}
    total_share = sum(t for t, _ in named.values()) or 1.0
    target = {s: t / total_share for s, (t, _) in named.items()}
    repeats = {s: m for s, (_, m) in named.items()}
    wanted = records.groupBy("source").agg(F.sum("tokens").alias("t"))
    supply = {r["source"]: int(r["t"] or 0) for r in wanted.join(targets.select("source").distinct(), "source").collect()}
    if budget == "exact":
        budget = min((supply.get(s, 0) * repeats[s] / target[s] for s in target if target[s] > 0), default=0)
    elif budget is None:
        budget = records.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    demand = demands(supply, target, repeats, float(budget))
    more = {s for s in target if demand[s] > supply.get(s, 0)}
    up, down = sum(demand[s] for s in more), sum(demand[s] for s in target if s not in more)
    low = TILT * min(1.0, up / down) if down else 0.0
    high = low * down / up if up else 0.0
    return [(s, target[s], repeats[s], supply.get(s, 0), demand[s], high if s in more else -low if up else 0.0) for s in sorted(target, key=str)]


def pieces(points: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """``(u0, u1, t0, t1, w0, w1)`` of the straight pieces of a schedule: over ``t0 .. t1`` the weight goes
    from ``w0`` to ``w1`` and the share of the source's tokens from ``u0`` to ``u1``; weights are scaled to the integral 1."""
    at: dict[float, float] = {}
    for t, w in points:
        if t is not None and w is not None and w >= 0:
            t = min(1.0, max(0.0, float(t)))
            at[t] = max(at.get(t, 0.0), float(w))
    if not any(at.values()):
        return []
    ts = sorted(at)
    course = [(0.0, at[ts[0]])] * (ts[0] > 0) + [(t, at[t]) for t in ts] + [(1.0, at[ts[-1]])] * (ts[-1] < 1)
    if len(course) == 1:
        course = [(0.0, 1.0), (1.0, 1.0)]
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairwise(course))
    if area <= 0:
        return []
    out, u = [], 0.0
    for (t0, w0), (t1, w1) in pairwise(course):
        more = (t1 - t0) * (w0 + w1) / 2 / area
        if more > 0:
            out.append((u, u + more, t0, t1, w0 / area, w1 / area))
        u += more
    return out


def mix(records: DataFrame, targets: DataFrame, budget: float | str | None = None, seed: int = 7, bucket_rows: int = BUCKET_ROWS, schedules: DataFrame | None = None) -> DataFrame:
    """``records(doc_id, source, tokens)`` → ``(position, doc_id, copy, source, tokens)``, sorted;
    ``schedules(source, t, weight)``, some points a source, says when a source is wanted more."""
    records = cut_lineage(records.select("doc_id", "source", "tokens"))
    spark = records.sparkSession
    points: dict = {}
    for r in schedules.collect() if schedules is not None else ():  # a parameter table, some rows a source
        points.setdefault(r["source"], []).append((r["t"], r["weight"]))
    rows = [(s, w, m, n, d, pieces(points.get(s, [])) or pieces([(0.0, 1 - tilt), (1.0, 1 + tilt)])) for s, w, m, n, d, tilt in plan(records, targets, budget)]
    course = "array<struct<u0: double, u1: double, t0: double, t1: double, w0: double, w1: double>>"
    sources = spark.createDataFrame(rows, f"source string, target double, repeats int, supply bigint, demand double, course {course}").where("demand > 0 and supply > 0")
    buckets = max(1, -(-records.count() // bucket_rows))
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31))
    keyed = records.join(sources, "source").withColumn("h", h).withColumn("bucket", F.floor(F.col("h") * buckets / (1 << 31)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = running(sums, "source", [F.col("bucket")], {"before": F.col("t")}).drop("t")
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.withColumn("upto", F.sum("tokens").over(inside)).join(before, ["source", "bucket"])
    middle = F.col("before") + F.col("upto") - F.col("tokens") / 2
    passes = F.least(F.col("repeats").cast("bigint"), F.ceil(F.col("demand") / F.col("supply")))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1))).withColumn("u", (F.col("copy") * F.col("supply") + middle) / F.col("demand"))
    copies = copies.where(F.col("u") <= 1).withColumn("p", F.coalesce(F.try_element_at(F.filter("course", lambda p: F.col("u") <= p["u1"]), F.lit(1)), F.element_at("course", -1)))
    # within a piece w0 x + slope x^2 / 2 tokens are wanted by t0 + x
    rest, slope = F.greatest(F.col("u") - F.col("p.u0"), F.lit(0.0)), (F.col("p.w1") - F.col("p.w0")) / (F.col("p.t1") - F.col("p.t0"))
    root = F.col("p.w0") + F.sqrt(F.greatest(F.col("p.w0") * F.col("p.w0") + 2 * slope * rest, F.lit(0.0)))
    t = F.least(F.col("p.t1"), F.col("p.t0") + F.when(root > 0, 2 * rest / root).otherwise(0.0))
    used = copies.select(t.alias("position"), "doc_id", "copy", "source", "tokens")
    return used.repartitionByRange("position", "source", "doc_id").sortWithinPartitions("position", "source", "doc_id", "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: ``source, target_share, reached_share, tokens, copies, most_copies``."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), (F.max("copy") + 1).alias("most_copies"))
    named = targets.select("source", "target_share", "max_repeats").distinct()
    out = named.join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(W.partitionBy()))  # one row a source
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
