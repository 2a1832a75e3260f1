"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

All suffixes of a corpus are too many to sort, so ranking starts from a sparse set of them, chosen by content:

1. Every window of ``length`` bytes holds an anchor, its first least-hashed ``GRAM``-byte string. Windows in a row with the
   same anchor are one run; equal windows have equal anchors, so only runs whose anchor stands elsewhere too can repeat.
2. Runs that are equal as a whole are ranked by one sort: all windows of all but the first repeat.
3. The first runs of an anchor with several different runs (the edges of repeated passages) go to rounds of prefix doubling.
   A string's rank is the earliest place where it stands. Strings start around the anchors, each shared by some neighbouring
   windows. In each round Spark sorts the pairs (rank of the string so far, bytes at growing offsets to both sides) and ranks
   them anew; what has become unique leaves, the rest parts into longer strings of fewer windows, up to ``length`` bytes.
   The bytes around an anchor travel with its row, so texts are read once for all rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import arrow_rows, one_text, saved

LENGTH = 100
#: Bytes of an anchor.
GRAM = 28
#: Neighbouring windows that share the string ranked in each round.
WIDTHS = (32, 8, 2, 1)
#: Bytes of a text that are hashed at once.
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20_24).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[k : k + 1] = [np.multiply.accumulate(p)]
    return _POWERS[0], _POWERS[1]


class Hashes:
    """Karp-Rabin hashes (mod 2**64, mixed) of all substrings of one piece of bytes."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        up, self.down = _powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * up[: len(b)], out=self.sums[1:])

    def at(self, start: np.ndarray, size) -> np.ndarray:
        h = (self.sums[start + size] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        h = (self.sums[size:] - self.sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def segments(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Pieces that share length - 1 bytes, so that each window lies in exactly one."""
    for at in range(0, max(1, len(data) - length + 1), SEGMENT):
        yield at, data[at : at + SEGMENT + length - 1]


def runs_of(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one piece: (first window, windows, from it to the anchor, anchor hash, hash of the run's bytes)."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 5
    kr = Hashes(data)
    g = kr.every(gram)
    place = np.uint64((1 << 24) - 1)
    least = (g & ~place) | np.arange(len(g), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    anchor = (least & place).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.concatenate((start, [len(anchor)])))
    at = anchor[start]
    return start, count, at - start, g[at].view(np.int64), kr.at(start, count + length - 1).view(np.int64)


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(4)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, piece in segments(text.encode(), length):
                    s, n, to_a, a, f = runs_of(piece, length, gram)
                    for col, x in zip(parts, (np.full(len(s), doc, np.int64), ((s + at) << 20) | (n << 10) | to_a, a, f)):
                        col.append(x)
            cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "snt", "a", "f"])

    return run


def _stretches(length: int, width: int):
    """For each edge and cell of ``width`` windows that it has: the bytes before the anchor and from it on that the cell's windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, edges in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = text.encode()
                for e in edges:
                    a, low, high = e["a"], e["low"], e["high"]
                    for lo in range(low - low % width, high + 1, width):
                        rows.append((doc, a, lo, low, high, data[a - min(lo + width - 1, high) : a], data[a : a + length - max(lo, low)]))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc", "a", "lo", "low", "high", "before", "after"])

    return run


def _bytes(data: str, start: Column, end: Column) -> Column:
    """Bytes start..end-1, counted from 0."""
    return F.substring(F.col(data), (start + 1).cast("int"), (end - start).cast("int"))


def double_ranks(docs: DataFrame, edges: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Prefix doubling over the windows of ``edges(doc, a, low, high)`` up to ``length`` bytes.

    ``a`` is an anchor's place and low..high the offsets (bytes from a window's start to the anchor) of its windows. Windows of a
    cell have offsets lo..lo+width-1 and share the string from lo bytes before the anchor to length - (lo + width - 1) bytes after its
    start. Each round pairs the rank of the last round's string with the bytes that the new one has beyond it on both sides.
    Returns ``(doc, start, end)`` of windows that also start earlier.
    """
    lists = saved(edges.groupBy("doc").agg(F.collect_list(F.struct("a", "low", "high")).alias("edges")))
    texts = docs.join(lists.hint("merge"), "doc").select("doc", "text", "edges")
    cells = saved(texts.mapInArrow(_stretches(length, widths[0]), "doc long, a long, lo int, low int, high int, before binary, after binary"))
    cells = cells.withColumns({"rank_doc": F.lit(0).cast("long"), "rank_at": F.lit(0).cast("long"), "old_left": F.lit(0), "old_right": F.lit(0)})
    key = ["rank_doc", "rank_at", "lo", "left", "right"]
    for width, finer in zip(widths, (*widths[1:], 0)):
        reach = F.length("before")
        right_end = F.greatest(length - F.col("lo") - (width - 1), F.lit(0))
        grown = cells.withColumn("left", _bytes("before", reach - F.col("lo"), reach - F.col("old_left"))).withColumn("right", _bytes("after", F.col("old_right"), right_end))
        groups = grown.groupBy(*key).agg(F.min(F.struct("doc", (F.col("a") - F.col("lo")).alias("at"))).alias("g"), F.count(F.lit(1)).alias("c")).where("c > 1")
        company = grown.join(groups.hint("merge"), key).select("doc", "a", "lo", "low", "high", "before", "after", "g")
        if not finer:
            break
        parts = company.withColumn("lo_", F.explode(F.sequence(F.col("lo"), F.col("lo") + (width - finer), F.lit(finer))))
        parts = parts.where((F.col("lo_") <= F.col("high")) & (F.col("lo_") + (finer - 1) >= F.col("low")))
        keep_left = F.least(F.col("lo_") + (finer - 1), F.col("high"))
        cells = saved(parts.select(
            "doc", "a", F.col("lo_").alias("lo"), "low", "high",
            _bytes("before", reach - keep_left, reach).alias("before"), _bytes("after", F.lit(0), length - F.greatest("lo_", "low")).alias("after"),
            F.col("g.doc").alias("rank_doc"), F.col("g.at").alias("rank_at"), F.col("lo").alias("old_left"), right_end.alias("old_right"),
        ))
    start = F.col("a") - F.col("lo")
    return company.where(F.struct("doc", start.alias("at")) > F.col("g")).select("doc", start.alias("start"), (start + length).alias("end"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, start, end): byte runs covered by windows of ``length`` bytes that also start earlier.

    Runs of one document may overlap. ``docs(doc, text)`` has no null doc.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    # made twice, for the anchors' counts and for the runs of those that repeat: writing all runs would take more disk than hashing takes time
    runs = docs.where(F.octet_length("text") >= length).mapInArrow(_runs(length, gram), "doc long, snt long, a long, f long")
    busy = runs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a")
    near = saved(runs.join(busy.hint("merge"), "a", "left_semi"))
    # equal runs have equal counts and anchors, so the packed facts order by their start
    first = saved(near.groupBy("a", "f").agg(F.min(F.struct("doc", "snt")).alias("g"), F.count(F.lit(1)).alias("c")))
    s, n, to_a = F.shiftright("snt", 20), F.shiftright("snt", 10).bitwiseAND(F.lit(1023)), F.col("snt").bitwiseAND(F.lit(1023))
    whole = near.join(first.where("c > 1").hint("merge"), ["a", "f"]).where(F.struct("doc", "snt") > F.col("g")).select("doc", s.alias("start"), (s + n + (length - 1)).alias("end"))
    split = first.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a")
    edges = first.join(split.hint("merge"), "a", "left_semi").select("g.doc", "g.snt").select("doc", (s + to_a).alias("a"), (to_a - n + 1).cast("long").alias("low"), to_a.cast("long").alias("high"))
    widths = tuple(w for w in WIDTHS if 2 * w <= length - gram + 1) or (1,)
    return whole.unionByName(double_ranks(docs, edges, length, widths))


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data, at, kept, merged = text.encode(), 0, [], _merge(spans or [])
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left)[: 5 + keep_bytes])
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_bytes``, ``kept`` (binary) for every row.

    A byte goes if a ``length``-byte string over it also starts earlier (smaller doc_id, or the same document and an earlier
    start), judged on the input; overlaps count. Null texts are empty; texts under ``length`` bytes keep all. Rows that repeat a doc_id
    are one document, for which its longest text stands (ties: the greatest), and are each returned. A null doc_id has no place in the
    order: such a row keeps all its bytes, and no other loses any for it. Other columns are ignored.
    """
    rows = one_text(docs).select(F.col("doc_id").alias("doc"), "text")
    spans = repeated_windows(rows, length, gram)
    lists = saved(spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    cut = rows.join(lists.hint("merge"), "doc", "left").select("doc", "text", "spans").mapInArrow(_cut(keep_bytes), schema)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").join(cut.hint("merge"), "doc_id")
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    zero = F.lit(0).cast("long")
    lone = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), *([data.alias("kept")] if keep_bytes else []))
    return out.unionByName(lone)
