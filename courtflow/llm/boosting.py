"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text is measured once, whole. Trees of one depth are grown on gradient histograms of binned statistics of a bounded sample of
labelled rows, and stored as flat arrays (statistic, limit, leaf value, by tree and place), which numpy walks for all rows of a
batch and all trees at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import arrow_rows, saved
from courtflow.llm.quality import text_stats

#: Most labelled rows that trees are grown on (those of the least hashes of their doc_ids).
MAX_ROWS = 40_000
BINS, DEPTH, TREES = 64, 4, 80
RATE, PULL, LEAST = 0.12, 1.0, 2.0

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "stop": map(ord, ".,;:?"), "bang": map(ord, "!"), "quote": map(ord, "\"'`"),
    "pipe": map(ord, "|"), "sign": map(ord, "#*$%&<>@^~=+_\\/"), "bracket": map(ord, "()[]{}"), "control": [*range(9), *range(14, 32), 127], "wide": range(128, 256),
}
_BYTES = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _BYTES[list(_members), _i] = 1.0
NAMES = ["words", "word_chars", "symbols", "dup_lines", "repeat_words", *_CLASSES, "bytes", "entropy", "lines", "distinct_words", "top_word", "short_words", "long_words", "stopped_lines", "capitals", "number_words"]


def measure(text: str | None) -> list[float]:
    """The statistics ``NAMES`` of a whole text, sizes on a log scale and counts as shares; null is empty."""
    text = text or ""
    data = text.encode()
    n, chars, symbols, dup, repeat = text_stats(text)
    size, some = max(1, len(data)), max(1, n)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = counts @ _BYTES / size
    p = counts[counts > 0] / size
    words = data.split()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(n), chars / some, symbols / some, dup / max(1, len(lines)), repeat / some, *shares, math.log1p(len(data)), float(-(p * np.log(p)).sum()), len(lines) / some,
        len(seen) / some**0.8, max(seen.values(), default=0) / some, float((lengths <= 3).sum()) / some, float((lengths >= 12).sum()) / some,
        sum(x.rstrip()[-1:] in b".!?:;" for x in lines) / max(1, len(lines)), sum(w.isupper() for w in words) / some, sum(w[:1].isdigit() for w in words) / some,
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "x"])


def fold() -> Column:
    """crc32 of doc_id as text, mod 5; rows of remainder 0, and of null doc_id, are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)), F.lit(0))


@dataclass(frozen=True)
class Trees:
    """Complete trees in level order. Place p of tree t asks whether statistic ``feature[t, p]`` is above ``limit[t, p]``; its children
    are 2p + 1 and 2p + 2, and those below the last level are the leaves."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of leaf values for each row of x, all trees at once."""
        trees = np.arange(len(self.leaf))
        place = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        while len(trees) and place.size and place[0, 0] < inner:
            place = 2 * place + 1 + (x[rows, self.feature[trees, place]] > self.limit[trees, place])
        return self.base + self.leaf[trees, place - inner].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees for the log loss of targets ``y`` (0 to 1). No rows, or targets of one kind: no trees, the smoothed share stands."""
    n, d = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = math.log(share / (1 - share))
    if not n or y.min() == y.max():
        return Trees(base, np.zeros((0, 0), np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 1)))
    limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for f in range(d)]
    binned = np.stack([np.searchsorted(limits[f], x[:, f], "left") for f in range(d)], 1)  # bin b: above limit b - 1, not above limit b
    flat = binned + np.arange(d) * bins
    inner = (1 << depth) - 1
    feature, limit, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g, h = p - y, p * (1 - p)
        place = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            width, at = 1 << level, ((place * d * bins)[:, None] + flat).ravel()
            sums = [np.bincount(at, np.repeat(w, d), width * d * bins).reshape(width, d, bins).cumsum(2) for w in (g, h)]
            (gl, hl), (ga, ha) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + PULL) + (ga - gl) ** 2 / (ha - hl + PULL) - ga**2 / (ha + PULL)
            gain[(hl < LEAST) | (ha - hl < LEAST)] = 0.0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(limits[f]):
                    feature[t, width - 1 + k], limit[t, width - 1 + k] = f, limits[f][b]
            node = width - 1 + place
            place = 2 * place + (x[np.arange(n), feature[t, node]] > limit[t, node])
        gs, hs = (np.bincount(place, w, inner + 1) for w in (g, h))
        leaf[t] = -RATE * gs / (hs + PULL)
        margin += leaf[t, place]
    return Trees(base, feature, limit, leaf)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` (``NAMES``) for every row of ``docs(doc_id, text)``."""
    arrow_rows(docs.sparkSession)
    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_measured, "doc_id long, x array<float>")


def train(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees from measured rows and ``labels(doc_id, quality)``, held-out rows left out.

    Labels other than 0 and 1 and null doc_ids are skipped; several labels of a doc_id count as their mean. Beyond ``max_rows``
    labelled rows, those of the least hashes of their doc_ids are taken.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").where(fold() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    rows = stats.where(fold() != 0).join(marked.hint("merge"), "doc_id")
    taken = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).select("x", "y").toArrow()
    x = taken.column("x").combine_chunks()
    return grow(x.flatten().to_numpy().reshape(len(x), len(NAMES)), taken.column("y").to_numpy())


def scored(stats: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, score`` of measured rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(len(b), len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.scores(x), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    ``labels`` teach as ``train`` says; without any, all scores are 0.5. Each row is scored by its own text: repeated rows stay, null and
    empty texts are measured as empty, rows of null doc_id are scored and held out. Other columns are ignored; no rows, no result.
    """
    stats = saved(statistics(docs))
    out = scored(stats, train(stats, labels, max_rows)).select("doc_id", (fold() == 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
