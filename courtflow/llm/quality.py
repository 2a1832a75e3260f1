"""Quality rules: base statistics of each text and robust multivariate outliers per language and source.

Minimum covariance determinant: the estimate of a group rests on those of its rows whose covariance has the least determinant.
The search begins at several places (the medians, and the means of parts of the group) and takes concentration steps from each:
a step keeps ``HALF`` of the group, the rows that lie nearest by Mahalanobis distance, and re-estimates mean and covariance from them.
A start's steps end when the determinant falls no more, however many that takes; the start that led to the least one wins.
A step is one aggregation over all rows into distance bins per group and start, which hold counts, sums and products, so no group
meets in one task; of the bin in which the share ends, each row counts in part, so that all steps rest on the same weight of rows. Determinants are those of covariances with ``FLOORS`` added, as several statistics hardly vary in clean text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.common import arrow_rows, saved, sized

SYMBOLS = "#*$%&|<>"
#: Share of a group's rows that the estimate rests on, and rows under which a group is judged by a wider one (``judged_by`` tells which).
HALF = 0.6
MIN_ROWS = 40
#: Rejected beyond this squared distance (a chi-square quantile far out, as text statistics have long tails).
CUTOFF = 60.0
#: Least standard deviations of the transformed statistics: several hardly vary in clean text.
FLOORS = (0.6, 0.10, 0.15, 0.10, 0.10)
_BINS = 64.0
#: Starts besides the medians: parts of a group's rows by hash, one in ``PART`` rows each.
STARTS = 3
PART = 8
#: Most models that are broadcast (some 300 bytes each).
BROADCAST_MODELS = 50_000

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: empty).

    Words are ``[^\\x20\\x09-\\x0D]+``; n_repeat_words counts words in three-word windows that the text has twice or more.
    """
    text = text or ""
    data = text.encode()
    words = data.split()
    lines: dict[bytes, int] = {}
    dup = 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line.strip():
                dup += line in lines
                lines[line] = 1
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    n = len(words)
    if n < 4:
        return n, chars, symbols, dup, 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    v = len(names)
    three = ids[:-2]
    if v < 2_000_000:
        three = (three * v + ids[1:-1]) * v + ids[2:]
    else:  # beyond 63 bits: number the pairs first
        _, pair = np.unique(three * v + ids[1:-1], return_inverse=True)
        three = pair * v + ids[2:]
    order = np.argsort(three, kind="stable")
    same = three[order][1:] == three[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return n, chars, symbols, dup, int(covered.sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for b in batches:
        rows = [text_stats(t) for t in b.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "lang", "source", *names])


def vector() -> list[Column]:
    """Transformed statistics: size, mean word length, symbols, repeated lines and repeated windows, each on a log scale."""
    words = F.greatest("n_words", F.lit(1))
    return [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / words),
        F.log1p(10 * F.col("n_symbols") / words),
        F.log1p(10 * F.col("n_dup_lines") / words),
        F.log1p(F.col("n_repeat_words") / words),
    ]


_P = len(FLOORS)
_MODEL = "start int, n long, mean array<double>, inv array<double>, det double"
_SOURCE = ("lang", "source")
#: The groups that models are made for: a language and source (level 0), a language (1), all rows (2).
_LEVEL = ("level", "lang", "source")


def _products() -> list[Column]:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)]
    return sums + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(_P) for j in range(i, _P)]


def _estimates(sums: DataFrame, key: Sequence[str]) -> DataFrame:
    """A model from each row of ``sums`` (``m`` rows added up, out of ``n``), with the log of the determinant of its covariance."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            m = g.m.to_numpy(float)
            mean = g[[f"s{i}" for i in range(_P)]].to_numpy(float) / m[:, None]
            cov = np.empty((len(g), _P, _P))
            for i in range(_P):
                for j in range(i, _P):
                    cov[:, i, j] = cov[:, j, i] = g[f"p{i}_{j}"].to_numpy(float) / m - mean[:, i] * mean[:, j]
            # the nearest part of a normal sample spreads less than the whole: scale as at half the rows, then floor
            cov = cov * 2.0 + np.diag(np.square(FLOORS))
            out = g[[*key, "start", "n"]].copy()
            out["mean"] = list(mean)
            out["inv"] = list(np.linalg.inv(cov).reshape(len(g), _P * _P))
            out["det"] = np.linalg.slogdet(cov)[1]
            yield out

    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    return sums.mapInPandas(fit, ", ".join(f"{k} {types[k]}" for k in key) + f", {_MODEL}")


def _start(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Median and MAD-like spread of each coordinate in each group, from histograms (bounded by bins, not by rows), and parts of the rows."""
    bins = F.array(*(F.floor(F.col(f"x{i}") * _BINS).cast("int") for i in range(_P)))
    hist = rows.select(*key, F.posexplode(bins).alias("i", "b")).groupBy(*key, "i", "b").agg(F.count(F.lit(1)).alias("c"))
    one = Window.partitionBy(*key, "i")
    half = F.floor((F.col("n") + 1) / 2)
    at = hist.withColumn("x", (F.col("b") + 0.5) / _BINS).withColumn("n", F.sum("c").over(one)).withColumn("seen", F.sum("c").over(one.orderBy("x")))
    at = at.withColumn("mid", F.min(F.when(F.col("seen") >= half, F.col("x"))).over(one)).withColumn("away", F.abs(F.col("x") - F.col("mid")))
    at = at.withColumn("seen", F.sum("c").over(one.orderBy("away"))).groupBy(*key, "i", "n", "mid").agg(F.min(F.when(F.col("seen") >= half, F.col("away"))).alias("mad"))
    floor = F.get(F.array(*map(F.lit, FLOORS)), F.col("i"))
    at = at.withColumn("spread", F.greatest(1.4826 * F.col("mad"), floor))
    both = at.groupBy(*key).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(_P) for c in ("mid", "spread")))
    medians = both.select(
        *key, F.lit(0).alias("start"), "n", F.array(*(f"mid{i}" for i in range(_P))).alias("mean"),
        F.array(*(1 / F.col(f"spread{i}") ** 2 if i == j else F.lit(0.0) for i in range(_P) for j in range(_P))).alias("inv"),
        (2 * sum(F.log(f"spread{i}") for i in range(_P))).alias("det"),
    )
    # the other starts: each the mean and covariance of a part of the rows; a group without such rows has only the medians
    part = F.pmod(F.xxhash64(*(f"x{i}" for i in range(_P))), F.lit(PART)).cast("int")
    parts = rows.withColumn("start", part + 1).where(F.col("start") <= STARTS).groupBy(*key, "start").agg(F.count(F.lit(1)).alias("m"), *_products())
    return medians.unionByName(_estimates(parts.withColumn("n", F.col("m")), key))


def distance(mean: Column, inv: Column) -> Column:
    """Squared Mahalanobis distance of x0.. from a model."""
    d = [F.col(f"x{i}") - F.get(mean, F.lit(i)) for i in range(_P)]
    total = F.lit(0.0)
    for i in range(_P):
        for j in range(_P):
            total = total + d[i] * d[j] * F.get(inv, F.lit(i * _P + j))
    return F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))


def _few(model: DataFrame) -> DataFrame:
    return sized(model, BROADCAST_MODELS)


def _step(rows: DataFrame, model: DataFrame, key: Sequence[str]) -> DataFrame:
    """One concentration step: the nearest ``HALF`` of each group gives the new mean and covariance of each start.

    A row of ``model`` is a group and start, hinted for the join with all rows.
    """
    group = [*key, "start"]
    near = rows.join(model, list(key)).withColumn("b", F.floor(F.log2(distance(F.col("mean"), F.col("inv")) + 1e-6) * _BINS).cast("int"))
    binned = near.groupBy(*group, "b").agg(F.count(F.lit(1)).alias("c"), *_products())
    one = Window.partitionBy(*group)
    nearest = binned.withColumn("n", F.sum("c").over(one)).withColumn("before", F.sum("c").over(one.orderBy("b")) - F.col("c")).where(F.col("before") < HALF * F.col("n"))
    part = F.least(F.lit(1.0), (HALF * F.col("n") - F.col("before")) / F.col("c"))  # of the last bin, as much as is wanting
    sums = [F.sum(F.col(c) * F.col("part")).alias(c) for c in binned.columns if c[0] in "sp" and c[1].isdigit()]
    return _estimates(nearest.withColumn("part", part).groupBy(*group).agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("part")).alias("m"), *sums), key)


def _models(rows: DataFrame, key: Sequence[str] = _SOURCE) -> DataFrame:
    """The estimate of each group of ``rows``: of all starts, and steps from them, the one of the least determinant.

    A start takes steps until the log of its determinant falls by less than 1e-3, which ends as determinants have a floor; the table
    of each step holds the least one so far as ``best``.
    """
    group = [*key, "start"]
    at = saved(_start(rows, key).withColumn("best", F.lit(None).cast("struct<det:double,n:bigint,mean:array<double>,inv:array<double>>")).withColumn("falls", F.lit(True)))
    ended = []
    while True:
        more = at.where("falls")
        n = more.count()
        if not n:
            break
        ended.append(at.where("not falls"))
        strategy = "broadcast" if n <= BROADCAST_MODELS else "merge"
        new = _step(rows, more.select(*group, "mean", "inv").hint(strategy), key).join(more.select(*group, F.col("best").alias("old")).hint(strategy), group)
        falls = F.col("old").isNull() | (F.col("old.det") - F.col("det") > 1e-3)
        this = F.struct("det", "n", "mean", "inv")
        least = F.when(F.col("old").isNull() | (F.col("det") < F.col("old.det")), this).otherwise(F.col("old"))
        at = saved(new.select(*group, "n", "mean", "inv", "det", least.alias("best"), falls.alias("falls")))
    for table in ended:
        at = at.unionByName(table)
    return at.groupBy(*key).agg(F.min_by("best", F.struct("best.det", "start")).alias("m")).select(*key, "m.n", "m.mean", "m.inv")


def _groups(rows: DataFrame) -> DataFrame:
    """Each language and source with the groups that its rows count for (``levels``) and the one whose estimate judges them (``judge``)."""
    sizes = saved(rows.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")))
    tongues = sizes.groupBy("lang").agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    tiny = not tongues.where(F.col("all") < MIN_ROWS).isEmpty()
    level = [F.struct(F.lit(i).alias("level"), a.alias("lang"), b.alias("source")) for i, (a, b) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), F.lit("")), (F.lit(""), F.lit(""))])]
    own, tongue = F.col("n") >= MIN_ROWS, F.col("all") >= MIN_ROWS
    levels = F.array_compact(F.array(F.when(own, level[0]), F.when(tongue & (F.col("least") < MIN_ROWS), level[1]), F.when(F.lit(tiny), level[2])))
    judge = F.when(own, level[0]).when(tongue, level[1]).otherwise(level[2])
    return saved(sizes.join(tongues.hint("merge"), "lang").select("lang", "source", levels.alias("levels"), judge.alias("judge")))


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id``, five base statistics, ``base_failed``, ``distance2``, ``kept`` and ``judged_by`` for every row of ``docs(doc_id, text, lang, source)``.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. Other rows are kept unless their
    transformed statistics lie beyond ``cutoff`` (squared distance) from the estimate of their language and source, which is
    made from rows that pass the base rules. Groups under ``MIN_ROWS`` such rows are judged by the estimate of all rows of their
    language, and languages under it by that of all rows; judged_by says whose: "source", "lang" or "all". distance2 is null only if no row passes the base rules. Null languages
    and sources count as ``''``; null texts as empty. Repeated rows stay. Other columns are ignored; no rows, no result.
    """
    arrow_rows(docs.sparkSession)
    group = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *group).mapInArrow(_measure, STATS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = saved(stats.withColumn("base_failed", failed).select("*", *(x.alias(f"x{i}") for i, x in enumerate(vector()))))
    groups = _groups(rows)
    points = rows.where("not base_failed").join(_few(groups.select("lang", "source", "levels")), ["lang", "source"])
    points = saved(points.select(F.explode("levels").alias("k"), *(f"x{i}" for i in range(_P))).select("k.*", *(f"x{i}" for i in range(_P))))
    model = saved(_models(points, _LEVEL).select(F.struct(*_LEVEL).alias("judge"), "mean", "inv"))
    level = F.get(F.array(F.lit("source"), F.lit("lang"), F.lit("all")), F.col("judge.level")).alias("judged_by")
    judges = saved(groups.select("lang", "source", "judge").join(model.hint("merge"), "judge").select("lang", "source", "mean", "inv", level))
    judged = rows.join(_few(judges), ["lang", "source"], "left")
    d = distance(F.col("mean"), F.col("inv"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        d.alias("distance2"), (~F.col("base_failed") & F.coalesce(d <= cutoff, F.lit(True))).alias("kept"), "judged_by",
    )
