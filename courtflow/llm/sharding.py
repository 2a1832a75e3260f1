"""Minimum-cost-flow resharding.

Old shards supply rows, new shards demand them; a row that stays costs nothing, one that moves costs its bytes. Of every old shard
the smallest rows leave first, so all that the flow must know of it is how many rows it holds and what the one costs that leaves or
stays by whether the shard gets a place more. The flow is solved on these few numbers; each row then reads from the counts of its
shard's sizes whether it leaves, and from its number among the leaving ones where it goes. Files of shards that lose or gain rows are rewritten.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.common import numbered, saved

SHARDS = 24


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost >= 0) of a largest flow of least cost from s to t.

    Successive shortest paths with node potentials.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, room, price in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(room)
            cost.append(price)
    high = [0] * n
    while True:
        dist, came, heap = [None] * n, [-1] * n, [(0, s)]
        dist[s] = 0
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for e in out[v]:
                if cap[e]:
                    new = d + cost[e] + high[v] - high[to[e]]
                    if dist[to[e]] is None or new < dist[to[e]]:
                        dist[to[e]], came[to[e]] = new, e
                        heapq.heappush(heap, (new, to[e]))
        if dist[t] is None:
            return [cap[2 * k + 1] for k in range(len(arcs))]
        far = max(d for d in dist if d is not None)
        high = [h + (far if d is None else d) for h, d in zip(high, dist)]
        path, v = [], t
        while v != s:
            path.append(came[v])
            v = to[came[v] ^ 1]
        room = min(cap[e] for e in path)
        for e in path:
            cap[e] -= room
            cap[e ^ 1] += room


def leaving(have: dict[int, int], margin: dict[int, int], shards: int) -> tuple[dict[int, int], dict[int, int]]:
    """Rows that leave each old shard, and rows that each new shard gets, at least cost.

    ``have`` counts the rows of old shards, ``margin`` gives the size of the row that is the last to leave a shard of more than
    total // shards rows, if it gets no extra place. New shards hold total // shards rows, and total % shards of them one more.
    """
    base, extras = divmod(sum(have.values()), shards)
    olds = sorted(have)
    s, t, hub, extra, first = 0, 1, 2, 3, 4
    new = first + len(olds)
    arcs = []
    for i, j in enumerate(olds):
        arcs.append((s, first + i, have[j], 0))
        if 0 <= j < shards:  # all but the last row that may leave: leaving or staying, it is not up to the flow
            arcs.append((first + i, new + j, have[j], 0))
        over = have[j] - base if 0 <= j < shards else have[j]
        arcs.append((first + i, hub, max(0, over - 1), 1))
        arcs.append((first + i, hub, 1, max(1, margin.get(j, 1)) + 1))
    for j in range(shards):
        arcs += [(hub, new + j, base + 1, 0), (new + j, t, base, 0), (new + j, extra, 1, 0)]
    arcs.append((extra, t, extras, 0))
    flow = min_cost_flow(new + shards, arcs, s, t)
    out, into = dict.fromkeys(olds, 0), dict.fromkeys(range(shards), 0)
    for (a, b, _, _), f in zip(arcs, flow):
        if b == hub:
            out[olds[a - first]] += f
        elif a == hub:
            into[b - new] += f
    return out, into


def routes(out: dict[int, int], into: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Moves (old, lo, hi, new): leaving rows numbered lo..hi-1 of an old shard go to ``new``."""
    free = [[j, n] for j, n in sorted(into.items()) if n]
    moves = []
    for j, n in sorted(out.items()):
        at = 0
        while at < n:
            take = min(n - at, free[-1][1])
            moves.append((j, at, at + take, free[-1][0]))
            at, free[-1][1] = at + take, free[-1][1] - take
            if not free[-1][1]:
                free.pop()
    return moves


def reshard(docs: DataFrame, shards: int = SHARDS, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, old_shard, shard, slot, moved``, and the columns to ``carry``, for all rows of ``docs(doc_id, size, old_shard)``.

    Shard counts are at most one apart (law ``rows``) and the fewest bytes move that can. slot is gapless from 0 in each shard.
    Old shards outside 0..shards-1 are drained; a null one counts as -1. Null doc_ids and repeated rows are rows like others;
    empty input gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("size").cast("long").alias("size"), F.coalesce(F.col("old_shard").cast("int"), F.lit(-1)).alias("old_shard"), *carry)
    # one row for each size of a shard: few next to the rows
    sizes = rows.groupBy("old_shard", "size").agg(F.count(F.lit(1)).alias("_n"))
    to = F.sum("_n").over(Window.partitionBy("old_shard").orderBy("size"))
    sizes = saved(sizes.withColumn("_to", to).withColumn("_from", F.col("_to") - F.col("_n")))
    have = {r.old_shard: r.n for r in sizes.groupBy("old_shard").agg(F.sum("_n").alias("n")).collect()}
    base = sum(have.values()) // shards
    last = spark.createDataFrame([(j, n - base) for j, n in have.items() if 0 <= j < shards and n > base], "old_shard int, _last long")
    margin = sizes.join(F.broadcast(last), "old_shard").where("_from < _last and _last <= _to")
    out, into = leaving(have, {r.old_shard: r.size for r in margin.select("old_shard", "size").collect()}, shards)
    going = spark.createDataFrame([(j, n) for j, n in out.items() if n], "old_shard int, _out long")
    # rows of sizes below the edge leave, those of the edge as far as needed, by number
    gone = sizes.join(F.broadcast(going), "old_shard").where("_from < _out").select("old_shard", "size", F.least("_n", F.col("_out") - F.col("_from")).alias("_k"), "_n")
    some = gone.where("_k < _n").select("old_shard", "size", "_k")  # at most one size a shard
    whole = gone.where("_k = _n").groupBy("old_shard").agg(F.max("size").alias("_below"))
    marked = rows.join(F.broadcast(whole), "old_shard", "left").withColumn("_goes", F.coalesce(F.col("size") <= F.col("_below"), F.lit(False))).drop("_below")
    edge = marked.join(F.broadcast(some), ["old_shard", "size"])
    edge = numbered(edge, ["old_shard"], "doc_id", "_e", ties=["size", *carry]).withColumn("_goes", F.col("_e") < F.col("_k")).drop("_e", "_k")
    rest = marked.join(F.broadcast(some.select("old_shard", "size")), ["old_shard", "size"], "left_anti")
    dealt = rest.unionByName(edge)
    moves = spark.createDataFrame(routes(out, into), "old_shard int, _lo long, _hi long, shard int")
    names = ["doc_id", "size", "old_shard", "shard", *carry]
    moved = numbered(dealt.where("_goes").drop("_goes"), ["old_shard"], "doc_id", "_m", ties=["size", *carry]).join(F.broadcast(moves), "old_shard").where("_m >= _lo and _m < _hi").select(*names)
    stay = dealt.where("not _goes").withColumn("shard", F.col("old_shard")).select(*names)
    placed = numbered(stay.unionByName(moved), ["shard"], "doc_id", "slot", ties=["size", *carry])
    return placed.withColumn("moved", F.col("shard") != F.col("old_shard"))


def rewrite_shards(assigned: DataFrame, docs: DataFrame, path: str) -> list[int]:
    """Rewrite under ``path`` (one folder a shard) only the shards that lose or gain a document.

    ``assigned`` comes from ``reshard``; ``docs`` has the texts by doc_id and may be read from ``path`` itself. Untouched folders
    stay as they are. A null or repeated doc_id does not tell which text it means: ValueError, before anything is written.
    Returns the old shards that hold no document any more; their folders are stale and left for the caller to remove.
    """
    assigned = saved(assigned)
    if not assigned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        raise ValueError("texts can only be moved by doc_ids that are unique and not null")
    moved = assigned.where("moved")
    changed = moved.select("shard").union(moved.select("old_shard")).distinct()
    rows = assigned.join(F.broadcast(changed), "shard", "left_semi").select("doc_id", "shard", "slot")
    (
        docs.join(rows.hint("merge"), "doc_id")
        .repartition("shard", F.pmod(F.col("slot"), F.lit(16)))
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )
    old, new = assigned.select(F.col("old_shard").alias("shard")).distinct(), assigned.select("shard").distinct()
    return sorted(r.shard for r in old.exceptAll(new).collect())
