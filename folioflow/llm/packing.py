"""Filling containers of fixed capacity by mixture-controlled packing.

Deficit round-robin over one queue per source: every window (container) adds its capacity
times a source's target share to that source's deficit. The source with the largest deficit
gives the largest item its deficit covers, until no deficit covers any; a source whose next item
is larger than its deficit waits. What is then left of the space takes the items that fill it
best at the least overdraft, which later windows pay back. Items are dealt by hash to shards of bounded size that pack independently, so a
source with a third of all rows is spread like any other. What the sources are owed at the
start of a shard is known from the shards' token totals (a prefix sum over a small table),
so deficits carry across windows, and across shards up to the space left unused.

No item is split unless it alone exceeds the capacity; such an item gives full pieces
of the capacity, each its own container, and a remainder that is packed like an item.
The target shares default to the sources' shares of all tokens, as every item is packed.

Defined results: items of 0 tokens (null or empty texts) take no space and are packed;
null is a source of its own; capacities that are null or below 1 are ignored; repeated
rows are packed as often as they occur.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioflow.session import cut_lineage, running

SHARD_TOKENS = 4_000_000


def pack_shard(sizes: list[int], sources: list, owed: dict, shares: dict, capacity: int) -> list[tuple[int, int]]:
    """(item by position, container) of every item; ``owed`` is what each source is owed at the start."""
    queues: dict = {}
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        q = queues.setdefault(sources[i], ([], []))
        q[0].append(sizes[i])
        q[1].append(i)
    deficit = {s: owed.get(s, 0.0) for s in queues}
    out: list[tuple[int, int]] = []
    container = 0

    def give(s, at: int) -> int:
        z, waiting = queues[s]
        size = z.pop(at)
        out.append((waiting.pop(at), container))
        deficit[s] -= size
        if not z:
            del queues[s]
        return size

    while queues:
        for s in queues:
            deficit[s] += capacity * shares.get(s, 0.0)
        room = capacity
        while True:  # within its deficit each source gives the largest item it can, the neediest first
            able = [(deficit[s], k) for k, (s, (z, _)) in enumerate(queues.items()) if z[0] <= min(room, deficit[s])]
            if not able:
                break
            s = list(queues)[max(able, key=lambda x: (x[0], -x[1]))[1]]
            room -= give(s, bisect_right(queues[s][0], min(room, deficit[s])) - 1)
        while queues and room > 0:  # what is left of the space goes to items that fill it, at the least overdraft
            best = None
            for s, (z, _) in queues.items():
                at = bisect_right(z, room) - 1
                if at >= 0 and (best is None or max(0.0, z[at] - deficit[s]) - z[at] / 2 < best[0]):
                    best = (max(0.0, z[at] - deficit[s]) - z[at] / 2, s, at)
            if best is None:
                break
            room -= give(best[1], best[2])
        container += 1
    return out


def pack(items: DataFrame, sizes: DataFrame, item: str = "doc_id", source: str = "source", tokens: str = "tokens", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``items(item, source, tokens)`` and ``sizes(pack_id, capacity)`` →
    ``(pack_id, shard, container, item, source, piece, first_token, tokens)``."""
    items = cut_lineage(items.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(tokens).alias("tokens")))
    total = items.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    shards = max(1, -(-total // shard_tokens))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    per = dealt.groupBy("shard", "source").agg(F.sum("tokens").alias("t"))
    by_source = per.groupBy("source").agg(F.sum("t").alias("of_source"))
    by_shard = per.groupBy("shard").agg(F.sum("t").alias("of_shard"))
    # what each source is owed before a shard: its share of all earlier tokens less its own
    earlier = running(by_shard.withColumn("all", F.lit(0)), "all", [F.col("shard")], {"before": F.col("of_shard")}).select("shard", "before")
    own = running(per, "source", [F.col("shard")], {"own": F.col("t")})
    share = F.col("of_source") / F.lit(float(max(1, total)))
    carry = (
        own.join(earlier, "shard").join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("shard", "source", share.alias("share"), (share * F.col("before") - F.coalesce("own", F.lit(0))).alias("owed"))
    )
    # the table of capacities is a short parameter table; each item goes once to each capacity
    caps = sorted({(r["pack_id"], int(r["capacity"])) for r in sizes.where(F.col("capacity") >= 1).select("pack_id", "capacity").collect()}, key=str)
    pid = sizes.schema["pack_id"].dataType.simpleString()
    if not caps:
        caps_column = F.expr(f"cast(array() as array<struct<pack_id: {pid}, capacity: bigint>>)")
    else:
        caps_column = F.array(*[F.struct(F.lit(p).cast(pid).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in caps])
    state = carry.groupBy(F.col("shard").alias("of_shard")).agg(F.collect_list(F.struct("source", "share", "owed")).alias("state"))
    state = state.withColumn("c", F.explode(caps_column)).select("of_shard", F.col("c.pack_id").alias("of_pack"), "state")
    work = dealt.withColumn("c", F.explode(caps_column)).select("shard", "item", "source", "tokens", "c.pack_id", "c.capacity")
    keyed = work.groupBy("shard", "pack_id").cogroup(state.groupBy("of_shard", "of_pack"))

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        cols = ["pack_id", "shard", "container", "item", "source", "piece", "first_token", "tokens"]
        if rows.empty:
            return pd.DataFrame(columns=cols)
        rows = rows.sort_values("item", kind="stable")
        capacity, shard, pack_id = int(rows["capacity"].iloc[0]), int(rows["shard"].iloc[0]), rows["pack_id"].iloc[0]
        name = lambda s: None if s is None or s != s else s
        given = [(name(x["source"]), x["share"], x["owed"]) for x in state["state"].iloc[0]]
        shares, owed = {s: w for s, w, _ in given}, {s: o for s, _, o in given}
        whole, pieces = [], []
        full = 0
        for it, src, t in zip(rows["item"].tolist(), map(name, rows["source"].tolist()), rows["tokens"].tolist(), strict=True):
            piece = 0
            while t - piece * capacity > capacity:
                whole.append((full, it, src, piece, piece * capacity, capacity))
                owed[src] = owed.get(src, 0.0) - capacity
                piece += 1
                full += 1
            pieces.append((it, src, piece, piece * capacity, t - piece * capacity))
        for s in owed:  # the full containers are windows too
            owed[s] += full * capacity * shares.get(s, 0.0)
        placed = pack_shard([p[4] for p in pieces], [p[1] for p in pieces], owed, shares, capacity)
        out = whole + [(full + c, *pieces[i]) for i, c in placed]
        df = pd.DataFrame(out, columns=["container", "item", "source", "piece", "first_token", "tokens"])
        df["pack_id"], df["shard"] = pack_id, shard
        return df[cols]

    kind = items.schema["item"].dataType.simpleString()
    return keyed.applyInPandas(run, f"pack_id {pid}, shard bigint, container bigint, item {kind}, source string, piece bigint, first_token bigint, tokens bigint").withColumnRenamed("item", item)
