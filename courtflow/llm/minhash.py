"""MinHash near-duplicates with bottom-k sketches of one hash function.

1. Documents with the same shingle set become one class (their links are certain).
2. Each class keeps the k smallest hashes of its set. Classes that are linked share a least number of retained values (``_need``:
   certain for sets that the sketch holds whole, else a link at the threshold is missed with a chance under 4e-7), so it suffices to
   list each class under its rarest retained values, all but that number less one. Values of one class only go unlisted. With ``exact``
   sketches are whole sets, and nothing is left to chance.
3. Every list holds its members against its most central one. Only lists with members that are then in different components go on.
4. Short lists compare those members with each other. In long ones the overlap with the central member h bounds what two members can
   share: they need so many common elements beyond h's, and meet in lists of the rarest of those alone (``_beyond``). So a large group
   of copies costs its size, not its square. Members that lie so far within h that it bounds nothing, such as excerpts of one larger
   text, and those of crowded lists beyond h, meet by bands of minima under seeded mixes of the hashes (``band_keys``; a link at the
   threshold is missed with a chance of 2e-7), or, where nothing may be left to chance, by equal parts of their sets (``part_keys``).
5. The k smallest values of two sketches together estimate the similarity; far pairs go. All links are verified on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import arrow_rows, components, one_text, saved, sized

#: Values of a sketch.
SKETCH = 128
#: Estimates this many standard errors below the threshold are too low for a link.
ERRORS = 5.5
#: Members of a list that are all compared with each other; longer lists take the way by their central member, with the same links.
SHORT_LIST = 32


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than ``words`` words make one shingle of
    the whole sequence; no words, none.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens))], np.uint64)
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):  # a polynomial of the words' hashes, then a bijective mix
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _signed(h: np.ndarray) -> np.ndarray:
    """Order-preserving: the smallest unsigned value becomes the smallest signed one."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


_SETS = "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>"


def _sketches(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, sketch = [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, words)
                mark = xxhash.xxh3_128_intdigest(h.tobytes())
                n.append(len(h))
                f1.append((mark >> 64) - (1 << 63))
                f2.append((mark & ((1 << 64) - 1)) - (1 << 63))
                sketch.append(_signed(h[:k]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_shingles": pa.array(n, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "sketch": pa.array(sketch, pa.list_(pa.int64()))})

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "s": pa.array(sets, pa.binary())})

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, c): sizes of two full sets and of their intersection."""
    for b in batches:
        rows = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            rows.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["a", "b", "n_a", "n_b", "c"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, c, values): elements that the set of id shares with h's, and those that h's lacks."""
    for b in batches:
        same, parts = [], []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            new = np.setdiff1d(y, x, assume_unique=True)
            same.append(len(y) - len(new))
            parts.append(new.view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], ["h", "id", "c", "values"])


def estimate(x: Column, y: Column, k: int) -> Column:
    """Similarity from the ``k`` smallest values of two sketches together."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, x), y)) / F.size(union)


def _similar_sizes(n: Column, m: Column, percent: int) -> Column:
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def _with_sets(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(a, b, x, y): pairs with the full sets of both. Only the texts of their members become sets."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(sized(ids), "id", "left_semi")
    sets = saved(texts.mapInArrow(_full_sets(words), "id long, s binary"))
    first = sets.select(F.col("id").alias("a"), F.col("s").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    return pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b").select("a", "b", "x", "y")


def _linked(percent: int) -> Column:
    return 100 * F.col("c") >= percent * (F.col("n_a") + F.col("n_b") - F.col("c"))


def _floor(percent: int, k: int) -> float:
    """The least share of the values of two sketches together that both sets of a link hold."""
    t = percent / 100
    return t - ERRORS * (t * (1 - t) / k) ** 0.5


def _ceil_div(x: Column, y: int) -> Column:
    return F.floor((x + (y - 1)) / y).cast("long")


def _need(n: Column, percent: int, k: int) -> Column:
    """Retained values that a set of ``n`` shares with each of its links. Up to percent/100 * k elements, no link's set is
    beyond k, so sketches are whole sets and share percent of the larger one."""
    return F.when(n * 100 <= percent * k, _ceil_div(n * percent, 100)).otherwise(F.ceil(_floor(percent, k) * F.least(n, F.lit(k))))


def _rarest(sets: DataFrame, own: list[str], within: list[str], need: Column) -> DataFrame:
    """``sets(own.., values)`` listed as (own.., v, w) under the rarest of the values that occur twice or more ``within`` a group:
    all but ``need`` - 1 of them. Two rows that share ``need`` values or more share one of these. w sums up how often they occur."""
    values = sets.select(*own, F.explode("values").alias("v"))
    many = values.groupBy(*within, "v").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    shared = values.join(many.hint("merge"), [*within, "v"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("_c", "v"))).alias("_s"))
    shared = shared.withColumn("_p", (F.size("_s") - need + 1).cast("int")).where("_p > 0")
    w = F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + x["_c"])
    return shared.select(*own, w.alias("w"), F.explode(F.slice("_s", 1, F.col("_p"))).alias("_e")).select(*own, "w", F.col("_e.v").alias("v"))


def _links(pairs: DataFrame, heads: DataFrame, docs: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that are linked: far ones go by the estimate, the rest is verified on full sets."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = saved(heads.select("id", "sketch").join(sized(ids), "id", "left_semi"))
    first, second = (some.select(F.col("id").alias(c), F.col("sketch").alias(f"_{c}")).hint("merge") for c in "ab")
    near = pairs.join(first, "a").join(second, "b").where(estimate(F.col("_a"), F.col("_b"), k) >= _floor(percent, k)).select("a", "b")
    met = _with_sets(saved(near), docs, words).mapInArrow(_overlaps, "a long, b long, n_a long, n_b long, c long")
    return saved(met.where(_linked(percent)).select("a", "b"))


def _pairs_of(lists: DataFrame, keys: list[str], percent: int, more: Column | None = None) -> DataFrame:
    """Pairs of different components in lists; ``more`` is a further condition on a row and its ``_2`` partner."""
    other = lists.select(*keys, *(F.col(c).alias(f"{c}_2") for c in lists.columns if c not in keys))
    fit = (F.col("id") < F.col("id_2")) & (F.col("comp") != F.col("comp_2")) & _similar_sizes(F.col("n"), F.col("n_2"), percent)
    both = lists.hint("merge").join(other, keys).where(fit if more is None else fit & more)
    return both.select(F.col("id").alias("a"), F.col("id_2").alias("b"))


def _borders(n: int, percent: int) -> list[int]:
    """Where classes of sizes begin, up to the first beyond ``n``: sizes of a link are of one class or of neighbours."""
    out = [1]
    while out[-1] <= n:
        out.append(out[-1] * 100 // percent + 1)
    return out


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def part_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """64-bit keys of a set (sorted hashes): two linked sets have one in common.

    Sets of a link whose smaller one is of a class of sizes differ in at most D elements. Of D // 2 + 1 groups of hashes one has no two of
    them; of the three parts of that group two have none, so these are equal, and so is their key. A set has keys for its own class,
    and for the one below as the larger set of a link. Sets that are far apart differ within nearly every two parts.
    """
    n, out = len(hashes), []
    borders = _borders(n, percent)
    own = len(borders) - 2
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(hashes), dtype=np.uint64)))
    for k in range(max(0, own - 1), own + 1):
        most = borders[k + 1] - 1 if k == own else borders[own] - 1
        groups = (100 - percent) * most // percent // 2 + 1
        place = ((hashes >> np.uint64(32)) * np.uint64(3 * groups)) >> np.uint64(32)
        at = np.searchsorted(place, np.arange(3 * groups + 1, dtype=np.uint64))
        part = (sums[at[1:]] - sums[at[:-1]]).reshape(groups, 3)
        tag = np.arange(groups, dtype=np.uint64) * np.uint64(4) + (np.uint64(k) << np.uint64(40))
        for which, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            out.append(_mixed(_mixed(part[:, a] + _MIX[2]) * _MIX[0] + _mixed(part[:, b] * _MIX[2] + tag + np.uint64(which))))
    return np.concatenate(out)


#: Chance that a link at the threshold has no band in common, and the chance that one band of its is the same.
MISSED, SAME_BAND = 2e-7, 0.15


def band_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """64-bit keys of a set: each of a band of least values of the set under as many mixes. Two sets have the same key with the chance
    of their similarity to the power of the band's length, so far ones hardly ever, however many they are."""
    t = percent / 100
    rows = max(1, round(math.log(SAME_BAND) / math.log(t))) if t < 1 else 1
    bands = math.ceil(math.log(MISSED) / math.log1p(-(t**rows))) if t < 1 else 1
    seeds = _mixed(np.arange(1, rows * bands + 1, dtype=np.uint64) * _MIX[2])
    least = np.full(rows * bands, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, _mixed(hashes[at : at + 2048, None] ^ seeds).min(0))
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = _mixed(out * _MIX[2] + column)
    return out


def _parts(words: int, percent: int, exact: bool):
    keys_of = part_keys if exact else band_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(*(c.to_pylist() for c in b.columns)):
                keys = keys_of(shingle_hashes(text, words), percent).view(np.int64)
                yield pa.RecordBatch.from_pydict({"id": pa.array(np.full(len(keys), i)), "g": pa.array(keys)})

    return run


def _keys(some: DataFrame, docs: DataFrame, words: int, percent: int, exact: bool) -> DataFrame:
    """(id, g): the keys of ``some(id)`` that two of them have."""
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(sized(saved(some.select("id").distinct())), "id", "left_semi")
    keys = saved(texts.mapInArrow(_parts(words, percent, exact), "id long, g long"))
    many = keys.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("g")
    return saved(keys.join(many.hint("merge"), "g").select("id", "g"))


def _half(n: str) -> Column:
    return F.sum(F.expr(f"{n} * ({n} - 1) div 2"))


def _beyond(members: DataFrame, docs: DataFrame, words: int, percent: int, exact: bool) -> DataFrame:
    """Pairs of ``members(h, id, n, comp)`` of long lists that may be linked, h being the central member of the list.

    Two members share at most min(c_1, c_2) elements of h, c being what each shares with it, and a link needs
    percent / (100 + percent) * (n_1 + n_2) of them. Where that is within the bound, cells of equal (n, c) are matched
    first, then their members. Other pairs share as many elements beyond h's as are wanting, so they share one of the rarest.
    Lists that would pair more than h has members are held against keys (``band_keys``): the way of fewer pairs is taken.
    """
    held = _with_sets(members.select(F.col("h").alias("a"), F.col("id").alias("b")), docs, words).mapInArrow(_held, "h long, id long, c long, values array<long>")
    least = members.groupBy("h").agg(F.min("n").alias("_m"))
    facts = members.join(saved(held).hint("merge"), ["h", "id"]).join(least.hint("merge"), "h")
    wanting = _ceil_div(percent * (F.col("n") + F.greatest("_m", _ceil_div(F.col("n") * percent, 100))), 100 + percent) - F.col("c")
    facts = saved(facts.withColumn("wanting", wanting).drop("_m"))
    within = (100 + percent) * F.least("c", "c_2") >= percent * (F.col("n") + F.col("n_2"))
    cells = facts.where("wanting <= 0").groupBy("h", "n", "c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"))
    other = cells.select("h", *(F.col(c).alias(f"{c}_2") for c in ("n", "c", "lo", "hi", "k")))
    apart = (F.least("lo", "lo_2") != F.greatest("hi", "hi_2")) & (F.struct("n", "c") <= F.struct("n_2", "c_2"))
    met = saved(cells.hint("merge").join(other, "h").where(within & apart & _similar_sizes(F.col("n"), F.col("n_2"), percent)).select("h", "n", "c", "k", "n_2", "c_2", "k_2"))
    lists = saved(_rarest(facts, ["h", "id", "n", "comp", "c", "wanting"], ["h"], F.greatest("wanting", F.lit(1))).drop("w", "wanting", "c"))
    # what all this would pair, by h; where that is over the number of members, keys are tried, and taken where they pair fewer
    cost = lists.groupBy("h", "v").agg(F.count(F.lit(1)).alias("s")).groupBy("h").agg(_half("s").alias("pairs")).unionByName(met.groupBy("h").agg(F.sum(F.col("k") * F.col("k_2")).alias("pairs")))
    costly = cost.groupBy("h").agg(F.sum("pairs").alias("pairs")).join(facts.groupBy("h").agg(F.count(F.lit(1)).alias("size")).hint("merge"), "h").where("pairs > size")
    costly = saved(costly.select("h", "pairs"))
    if costly.isEmpty():
        return _plain(facts, met, lists, percent)
    crowd = facts.join(costly.hint("merge"), "h").select("h", "id", "n", "comp", "pairs")
    keys = _keys(crowd, docs, words, percent, exact)
    found = crowd.select("h", "id").join(keys.hint("merge"), "id").groupBy("h", "g").agg(F.count(F.lit(1)).alias("s")).groupBy("h").agg(_half("s").alias("found"))
    chosen = saved(costly.join(found.hint("merge"), "h", "left").where("coalesce(found, 0) < pairs").select("h"))
    some = crowd.join(chosen.hint("merge"), "h", "left_semi").select("id", "n", "comp").distinct()
    by_keys = _pairs_of(saved(keys.join(some.hint("merge"), "id")), ["g"], percent)
    rest = [t.join(chosen.hint("merge"), "h", "left_anti") for t in (facts, met, lists)]
    return _plain(*rest, percent).unionByName(by_keys)


def _plain(facts: DataFrame, met: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of the cells that were met, and of the lists of what lies beyond h."""
    one = facts.select("h", "n", "c", "id", "comp")
    two = facts.select("h", *(F.col(c).alias(f"{c}_2") for c in ("n", "c", "id", "comp")))
    direct = met.select("h", "n", "c", "n_2", "c_2").join(one.hint("merge"), ["h", "n", "c"]).join(two.hint("merge"), ["h", "n_2", "c_2"]).where("comp != comp_2 and id != id_2")
    direct = direct.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b"))
    return direct.unionByName(_pairs_of(lists, ["h", "v"], percent))


def _rest_pairs(lists: DataFrame, hubs: DataFrame, labels: DataFrame, docs: DataFrame, words: int, percent: int, exact: bool) -> DataFrame:
    """Pairs of list members in different components that may be linked, but for those with a list's central member."""
    placed = lists.select("v", "id", "n").join(labels.hint("merge"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    span = placed.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v")
    shown = hubs.select("v", F.col("head.id").alias("h"), "size").where("size > 2").join(span.hint("merge"), "v")
    open_ = saved(placed.join(shown.hint("merge"), "v").where("id != h"))
    short = _pairs_of(open_.where(F.col("size") <= SHORT_LIST).select("v", "id", "n", "comp"), ["v"], percent)
    members = saved(open_.where(F.col("size") > SHORT_LIST).select("h", "id", "n", "comp").distinct())
    if members.isEmpty():
        return short.distinct()
    return short.unionByName(_beyond(members, docs, words, percent, exact)).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH, exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable, kept says that it is the row's own. Null and empty texts, and texts of white space,
    have no shingles and no links. Rows that repeat a doc_id are one document, for which its longest text stands (ties: the
    greatest); each of them is returned. A null doc_id names no document: such a row has no links, null n_shingles and
    component_id, and is kept. Other columns are ignored. ``exact`` leaves no link to chance, at the cost of whole sets in all steps.
    """
    k = 1 << 30 if exact else k
    arrow_rows(docs.sparkSession)
    texts = one_text(docs)
    rows = saved(texts.mapInArrow(_sketches(words, k), _SETS))
    key = ["n_shingles", "f1", "f2"]
    classes = rows.where("n_shingles > 0").groupBy(*key).agg(F.min_by(F.struct("doc_id", "sketch"), "doc_id").alias("h"))
    heads = saved(classes.select(F.col("h.doc_id").alias("id"), F.col("n_shingles").alias("n"), "f1", "f2", F.col("h.sketch").alias("sketch")))
    lists = saved(_rarest(heads.select("id", "n", F.col("sketch").alias("values")), ["id", "n"], [], _need(F.col("n"), percent, k)))
    hubs = lists.groupBy("v").agg(F.max_by(F.struct("id", "n"), F.struct("w", -F.col("id"))).alias("head"), F.count(F.lit(1)).alias("size"))
    hubs = saved(hubs.where("size > 1"))
    stars = lists.join(hubs.hint("merge"), "v").where(F.col("id") != F.col("head.id")).where(_similar_sizes(F.col("n"), F.col("head.n"), percent))
    links = _links(saved(stars.select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()), heads, texts, words, percent, k)
    labels = components(links)
    more = saved(_rest_pairs(lists, hubs, labels, texts, words, percent, exact))
    if not more.isEmpty():
        labels = components(links.unionByName(_links(more, heads, texts, words, percent, k)))
    placed = heads.select("id", "n", "f1", "f2").join(labels.hint("merge"), "id", "left")
    placed = placed.select(F.col("n").alias("n_shingles"), "f1", "f2", F.coalesce("component", "id").alias("_c"))
    # a class's smallest id is its head, so the smallest head reachable is the smallest id reachable
    found = rows.select("doc_id", *key).join(placed.hint("merge"), key, "left").select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found.hint("merge"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
