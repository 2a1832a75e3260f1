"""Benchmark decontamination by greedy string tiling.

Word n-grams of the benchmark are the seeds. A document that shares one is tiled against that item: Karp-Rabin
hashes find all matches of the current length, the longest ones that overlap no earlier tile are marked, and the
length falls until the minimum. The share of the item's words under tiles is its coverage, whatever their order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import arrow_rows

#: Words of the shortest tile, and the least share of an item's words under tiles.
SEED = 5
COVERAGE = 0.5
#: Benchmark items that go to the executors at once; more are taken in blocks.
ITEMS = 20_000

_WORD = re.compile(r"\w+")
_B, _M = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _rolling(ids: list[int], n: int) -> list[int]:
    """Karp-Rabin hashes of all runs of ``n`` ids."""
    if len(ids) < n:
        return []
    h, top = 0, pow(_B, n - 1, _M)
    for x in ids[:n]:
        h = (h * _B + x + 1) % _M
    out = [h]
    for gone, come in zip(ids, ids[n:]):
        h = ((h - (gone + 1) * top) * _B + come + 1) % _M
        out.append(h)
    return out


def tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length), longest first; ties by place."""
    taken_i, taken_d = [False] * len(item), [False] * len(doc)
    out: list[tuple[int, int, int]] = []
    top = len(item)
    while top >= least:
        best, found = 0, []
        # the longest common run of unmarked words, by halving over the Karp-Rabin length
        lo, hi = least, top
        while lo <= hi:
            n = (lo + hi) // 2
            got = _matches(item, doc, taken_i, taken_d, n)
            if got:
                best, found, lo = n, got, n + 1
            else:
                hi = n - 1
        if not best:
            break
        for i, d in found:
            if not any(taken_i[i : i + best]) and not any(taken_d[d : d + best]):
                taken_i[i : i + best] = [True] * best
                taken_d[d : d + best] = [True] * best
                out.append((i, d, best))
        top = best
    return out


def _matches(item, doc, taken_i, taken_d, n: int) -> list[tuple[int, int]]:
    by_hash = defaultdict(list)
    for i, h in enumerate(_rolling(item, n)):
        if not any(taken_i[i : i + n]):
            by_hash[h].append(i)
    return [(i, d) for d, h in enumerate(_rolling(doc, n)) for i in by_hash.get(h, ()) if not any(taken_d[d : d + n]) and item[i : i + n] == doc[d : d + n]]


class _Index:
    """The seeds of a block of benchmark items. Items shorter than ``seed`` words match whole."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.seed, self.vocabulary, self.items = seed, {}, {}
        self.by_seed: dict[tuple, set] = defaultdict(set)
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.items[item_id] = ids
                n = min(seed, len(ids))
                for i in range(len(ids) - n + 1):
                    self.by_seed[tuple(ids[i : i + n])].add(item_id)
        self.lengths = sorted({len(s) for s in self.by_seed})

    def search(self, text: str | None) -> Iterator[tuple[int, int, int, int, list]]:
        """(item_id, words, covered, tiles, tile list) for each item that shares a seed."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        hits = set()
        for n in self.lengths:
            # places where n known words stand in a row
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            for p in np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else ():
                hits |= self.by_seed.get(tuple(ids[p : p + n].tolist()), set())
        if not hits:
            return
        listed = ids.tolist()
        for item_id in sorted(hits):
            item = self.items[item_id]
            near = _around(listed, set(item), min(self.seed, len(item)))
            got = tiles(item, near, min(self.seed, len(item)))
            yield item_id, len(item), sum(t[2] for t in got), len(got), got


def _around(ids: list[int], members: set[int], least: int) -> list[int]:
    """The document's runs of at least ``least`` item words, parted by a word of no item: tiles lie within them."""
    out, run = [], []
    for x in [*ids, 0]:
        if x in members:
            run.append(x)
        elif run:
            if len(run) >= least:
                out += [*run, 0]
            run = []
    return out


_FOUND = "doc_id long, item_id long, n_item_words long, n_covered long, n_tiles long, coverage double"


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of documents and benchmark items with tiles over ``coverage`` of the item's words.

    Columns ``doc_id, item_id, n_item_words, n_covered, n_tiles, coverage``. Words are ``\\w+`` in lower case; an
    item under ``seed`` words must stand there whole. Null and empty texts match nothing; repeated rows of a
    document repeat its pairs, repeated items count once (the least text of an item_id). An empty benchmark gives
    no pairs. Benchmark items are read in blocks of ``ITEMS``, so what a task holds is bounded. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    items = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    total = items.count()
    blocks = max(1, -(-total // ITEMS))
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            index = _Index(rows.value, seed)
            for batch in batches:
                out = [(d, i, n, c, t, c / n) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, n, c, t, _ in index.search(text) if c >= coverage * n]
                cols = list(zip(*out)) if out else [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "n_item_words", "n_covered", "n_tiles", "coverage"])

        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)
        found = got if found is None else found.unionByName(got)
    return found
