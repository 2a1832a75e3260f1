"""Mixing sources to target weights by Pfair scheduling.

While all sources have blocks, each is due its weight's share of the slots. A source that runs dry leaves, and the others share
its slots in proportion to their weights, until every block has a slot. So block j (from 0) of a source of weight w is due between
the slots that this even flow reaches at the times j / w and (j + 1) / w: its release (rounded down) and deadline (rounded up).
Earliest deadline first fills one block a slot, and meets all deadlines. Weights are taken exactly, as ratios of whole numbers.

The driver runs through the slots once and keeps what is placed at the start of each stretch of them; tasks then fill the stretches.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import numbered

#: Slots of a stretch, at least; there are always several for each source.
STRETCH = 4_096
#: Documents of a block.
BLOCK = 8


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period for each source: largest remainders; ties by name. A source may get none."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    got = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (got[s] - exact[s], s))[: period - sum(got.values())]:
        got[s] += 1
    return got


def schedule(quota: dict[str, int]) -> list[tuple[int, str, int, int, int]]:
    """All slots of sources with so many blocks, each at the weight of its count: (slot, source, block, release, deadline)."""
    names = sorted(s for s in quota if quota[s])
    flow = Flow([quota[s] for s in names], [float(quota[s]) for s in names])
    return [(slot, names[k], j, release, due) for slot, k, j, release, due in flow.fill([0] * len(names), 0, flow.total)]


class _Ratio:
    """n / d, only to be compared."""

    __slots__ = ("n", "d")

    def __init__(self, n: int, d: int):
        self.n, self.d = n, d

    def __lt__(self, other: _Ratio) -> bool:
        return self.n * other.d < other.n * self.d


class Flow:
    """The even flow of sources with ``blocks`` (over 0) and ``weights`` (over 0), and the slots that follow it."""

    def __init__(self, blocks: list[int], weights: list[float]):
        ratios = [float(w).as_integer_ratio() for w in weights]
        scale = max((d for _, d in ratios), default=1)
        self.blocks, self.weights = blocks, [n * (scale // d) for n, d in ratios]
        self.total = sum(blocks)
        # sources by the time at which they run dry, a ratio; phase p has the first p of them gone
        order = sorted(range(len(blocks)), key=lambda k: _Ratio(blocks[k], self.weights[k]))
        self.ends = [_Ratio(blocks[k], self.weights[k]) for k in order]
        self.gone = [0, *accumulate(blocks[k] for k in order)]
        whole = sum(self.weights)
        self.active = [whole - x for x in (0, *accumulate(self.weights[k] for k in order))]

    def at(self, k: int, j: int, up: bool) -> int:
        """The slot that the flow has reached when source ``k`` has ``j`` blocks, rounded up or down."""
        w = self.weights[k]
        p = bisect_left(self.ends, _Ratio(j, w))
        part = self.gone[p] * w + j * self.active[p]
        return -(-part // w) if up else part // w

    def even(self) -> int:
        """Slots until the first source runs dry."""
        return self.ends[0].n * self.active[0] // self.ends[0].d if self.ends else 0

    def fill(self, placed: list[int], lo: int, hi: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Slots lo..hi-1 as (slot, source, block, release, deadline), where ``placed`` counts each source's blocks before
        ``lo``; it is brought up to date on the way."""
        waiting = [(self.at(k, j, False), k) for k, j in enumerate(placed) if j < self.blocks[k]]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        for slot in range(lo, hi):
            while waiting and waiting[0][0] <= slot:
                release, k = heapq.heappop(waiting)
                heapq.heappush(ready, (self.at(k, placed[k] + 1, True), k, release))
            due, k, release = heapq.heappop(ready)
            if due <= slot:
                raise AssertionError("a deadline was missed")
            j = placed[k]
            placed[k] = j + 1
            yield slot, k, j, release, due
            if j + 1 < self.blocks[k]:
                heapq.heappush(waiting, (self.at(k, j + 1, False), k))


def tempered(docs: DataFrame, source: str = "source", alpha: float = 0.7) -> dict[str, float]:
    """Target weights from the corpus: each source's share of documents to the power ``alpha``. One row a source comes to the driver."""
    rows = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.s: float(r.n) ** alpha for r in rows}


_PLACES = "source string, block long, slot long, release long, deadline long"


def _places(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, flow = shared.value
        for b in batches:
            for lo, hi, placed in zip(*(c.to_pylist() for c in b.columns)):
                slots, who, blocks, releases, dues = zip(*flow.fill(placed, lo, hi))
                cols = [pa.array([names[k] for k in who], pa.string()), *(pa.array(x, pa.int64()) for x in (blocks, slots, releases, dues))]
                yield pa.RecordBatch.from_arrays(cols, ["source", "block", "slot", "release", "deadline"])

    return run


def mix(docs: DataFrame, weights: dict[str, float], block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Slots for all rows: ``doc_id, source, block, slot, release, deadline, in_mix`` (long, boolean).

    A source's documents are dealt by hash into blocks of ``block`` rows, and every block has its own slot from
    release <= slot < deadline; at every slot no source is off the even flow by a block. ``in_mix`` is true for slots up to
    the one where the flow runs the first source dry: within them every source has its weight's share. Later rows are marked false
    and have the weights of the sources that are left. Null sources count as the source ``''``; sources without a weight
    over 0 get none (null slot, false). Rows with null or repeated doc_id are numbered like others.
    Empty input gives an empty result. Columns beside doc_id and source are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"))
    count = {r.source: r.n for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(s for s in count if weights.get(s, 0) > 0)
    flow = Flow([-(-count[s] // block) for s in names], [weights[s] for s in names])
    size = max(stretch, 8 * len(names))
    starts, placed = [], [0] * len(names)
    for lo in range(0, flow.total, size):
        hi = min(lo + size, flow.total)
        starts.append((lo, hi, list(placed)))
        for _ in flow.fill(placed, lo, hi):
            pass
    stretches = spark.createDataFrame(starts, "lo long, hi long, placed array<long>")
    places = stretches.mapInArrow(_places(spark.sparkContext.broadcast((names, flow))), _PLACES)
    dealt = numbered(rows, ["source"], "doc_id", "_seq").withColumn("block", F.floor(F.col("_seq") / block))
    out = dealt.join(places.hint("merge"), ["source", "block"], "left").select("doc_id", "source", "block", "slot", "release", "deadline")
    return out.withColumn("in_mix", F.coalesce(F.col("slot") < F.lit(flow.even()).cast("long"), F.lit(False)))
