"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words that look disguised (look-alike digits and signs, separators,
stretched letters, letters set apart by spaces) become lattices of what each sign may stand for, and Viterbi decoding finds
the likeliest original under channel and language model. Words as restored are then scored: evidence weights of hashed words
and word beginnings, learned from labelled rows, and a logistic curve over all words of a document, the strongest counting most.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from courtflow.llm.common import arrow_rows

# The alphabet of the language model (0 is a word's edge, 1 any other sign) and the channel.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáçéèêëíîïñóôöúùûüßœæ"
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
SEPARATORS = ".-_*~'·,:/\\"

_CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
_SIDE = 64
_SWAP, _SKIP, _SQUEEZE = -2.0, -1.0, -0.5
#: Buckets of the evidence table; its size bounds what reaches the driver.
BUCKETS = 1 << 20
#: Rows by which rare evidence is drawn towards none, the weight of each next weaker word, and the words that a worker remembers.
PRIOR = 6.0
FADE = 0.5
REMEMBER = 400_000
_BIN = 4

_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„‘’¿¡…"
_APART = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|])(?:[ ](?:[^\W_]|[@$!|]))+(?!\S)")
_STRETCHED = re.compile(r"(.)\1\1")


def _codes() -> np.ndarray:
    table = np.ones(0x250, np.uint8)
    for c, i in _CODE.items():
        for x in (c, c.upper()):
            if len(x) == 1 and ord(x) < 0x250:
                table[ord(x)] = i
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = _codes(), np.zeros(_SIDE**3, np.int64)
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
                c = table[np.minimum(points, 0x24F)].astype(np.int32)
                total += np.bincount((c[:-2] * _SIDE + c[1:-1]) * _SIDE + c[2:], minlength=_SIDE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) from all texts, smoothed by lower orders; 64**3 numbers whatever the corpus holds."""
    rows = docs.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    three = np.zeros(_SIDE**3)
    for r in rows:
        three[r.code] = r.n
    three = three.reshape(_SIDE, _SIDE, _SIDE)
    one = three.sum((0, 1)) + 1
    p = np.broadcast_to(one / one.sum(), (_SIDE, _SIDE))
    for counts in (three.sum(0), three):
        total = counts.sum(-1, keepdims=True)
        p = (counts + 8 * p) / (total + 8)
    return np.log(p).astype(np.float32)


def disguised(word: str) -> bool:
    """Whether a lower-case word of any length without outer punctuation is worth decoding: letters and look-alikes, not letters only."""
    if len(word) < 3:
        return False
    if word.isalpha():
        return _STRETCHED.search(word) is not None
    odd = sum(c in LOOKALIKES or c in SEPARATORS for c in word)
    letters = sum(c.isalpha() for c in word)
    return letters + odd == len(word) and letters >= 1


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest original of a word: Viterbi over its lattice, states are the last two signs. Letters beyond the model's stay."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    previous = ""
    for c in word:
        options = [(x, _SWAP) for x in LOOKALIKES.get(c, "")]
        if c in _CODE or c.isalpha():
            options.append((c, 0.0))
        elif c in SEPARATORS or not options:
            options.append(("", _SKIP))
        if c == previous:
            options.append(("", _SQUEEZE))
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, text) in best.items():
            for out, cost in options:
                if out:
                    k = _CODE.get(out, 1)
                    state, value = (b, k), score + cost + float(model[a, b, k])
                else:
                    state, value = (a, b), score + cost
                if state not in new or value > new[state][0]:
                    new[state] = (value, (text, out) if out else text)  # a chain of signs, read back at the end
        best, previous = new, c
    chain = max(((score + float(model[a, b, 0]), -a, -b, text) for (a, b), (score, text) in best.items()), key=lambda x: x[:3])[3]
    signs = []
    while chain:
        chain, c = chain
        signs.append(c)
    return "".join(reversed(signs))


def raw_words(text: str | None) -> list[str]:
    """Lower-case words of a text, and its runs of single signs set apart by spaces, joined."""
    low = (text or "").lower()
    return low.split() + [m.group().replace(" ", "") for m in _APART.finditer(low)]


class Restorer(dict):
    """Raw word to restored word, worked out once."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model = model

    def __missing__(self, raw: str) -> str:
        word = raw.strip(_STRIP)
        found = raw if disguised(raw) and not word.isalpha() else word
        out = decode(found, self.model) if disguised(found) else word
        if len(self) > REMEMBER:
            self.clear()
        self[raw] = out
        return out


def features(word: str) -> list[int]:
    """Buckets of a restored word of any length: itself and its beginnings of 4 to 6 letters."""
    if not word:
        return []
    parts = {f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k)}
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


class _Features(Restorer):
    def __missing__(self, raw: str) -> tuple[int, ...]:
        word = Restorer.__missing__(self, raw)
        self[raw] = out = tuple(features(word))
        return out


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Features(model.value)
        counts = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found: set[int] = set()
                found.update(*map(seen.__getitem__, set(raw_words(text))))
                if found:
                    counts[toxic, np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_pydict({"f": pa.array(at, pa.int64()), "pos": pa.array(counts[1][at], pa.int64()), "neg": pa.array(counts[0][at], pa.int64())})
        at = np.flatnonzero((counts[1] == 0) & (counts[0] > 0))
        yield pa.RecordBatch.from_pydict({"f": pa.array(at, pa.int64()), "pos": pa.array(np.zeros(len(at)), pa.int64()), "neg": pa.array(counts[0][at], pa.int64())})

    return run


class _Weights(Restorer):
    """Raw word to the weight of its strongest feature, at least 0."""

    def __init__(self, model: np.ndarray, weights: np.ndarray):
        super().__init__(model)
        self.weights = weights

    def __missing__(self, raw: str) -> float:
        word = Restorer.__missing__(self, raw)
        self[raw] = out = float(max((self.weights[f] for f in features(word)), default=0.0))
        return out


def strength(text: str | None, weights: _Weights) -> float:
    """The sum over all distinct words of a text, strongest first, each ``FADE`` times as much as the one before."""
    total = 0.0
    for w in sorted(filter(None, map(weights.__getitem__, set(raw_words(text))))):
        total = w + FADE * total
    return total


def _strengths(model, table, first: int = 1):
    """The columns from number ``first`` on, and the strength of column 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model.value, table.value)
        for b in batches:
            s = [strength(t, weights) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[first:], pa.array(s, pa.float64())], [*b.schema.names[first:], "strength"])

    return run


def _curve(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic curve over (strength, toxic rows, other rows) by damped Newton steps, with a weak pull to a rising default."""
    a, b = 1.0, -4.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = -0.1 * (a - 1), -0.1 * (b + 4), 0.1, 0.0, 0.1
        for x, pos, neg in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            n, v = pos + neg, (pos + neg) * p * (1 - p)
            ga += (pos - n * p) * x
            gb += pos - n * p
            haa, hab, hbb = haa + v * x * x, hab + v * x, hbb + v
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 1.0 / max(abs(da), abs(db), 1e-9))
        a, b = max(0.05, a + scale * da), b + scale * db
    return a, b


def fold() -> Column:
    """crc32 of doc_id as text, mod 3; rows of remainder 1 are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame):
    """(character model, weights, slope, offset) as broadcasts and numbers.

    Evidence comes from labelled rows of fold 0, the curve from those of fold 2; fold 1 is never read here. Texts that occur
    several times count once, as toxic if any is. What reaches the driver is bounded by the model's sizes.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    model = spark.sparkContext.broadcast(character_model(docs))
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 1)
    rows = docs.select("doc_id", "text").where(fold() != 1).where("text is not null").join(marked.hint("shuffle_hash"), "doc_id")
    rows = rows.withColumn("fold", fold()).groupBy(F.xxhash64("text").alias("h"), F.col("fold")).agg(F.max("toxic").cast("int").alias("toxic"), F.first("text").alias("text"))
    first = rows.where("fold = 0").select("text", "toxic").mapInArrow(_evidence(model), "f long, pos long, neg long")
    sums = first.groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0")
    n = {r.toxic: r.n for r in rows.where("fold = 0").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # evidence against the share of toxic rows, rare evidence drawn towards none; only what speaks for label 1 comes here
    rate = (n.get(1, 0) + 1) / (n.get(0, 0) + 1)
    weigh = F.log((F.col("pos") + PRIOR * rate) / (F.col("neg") + PRIOR)) - math.log(rate) - 1.0
    found = sums.select("f", weigh.alias("w")).where("w > 0").toPandas()
    weights = np.zeros(BUCKETS, np.float32)
    weights[found.f.to_numpy()] = found.w.to_numpy()
    table = spark.sparkContext.broadcast(weights)
    second = rows.where("fold = 2").select("text", "toxic").mapInArrow(_strengths(model, table), "toxic int, strength double")
    bins = second.groupBy(F.round(F.col("strength") * _BIN).cast("int").alias("b")).agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).collect()
    a, b = _curve([(r.b / _BIN, r.pos, r.neg) for r in sorted(bins)])
    return model, table, a, b


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` teach only from rows with crc32(doc_id as text) mod 3 other than 1; null or other labels are
    skipped, no labels give scores under ``threshold``. Null and empty texts get the score of no evidence. held_out of a null
    doc_id is null. Repeated rows stay; other columns are ignored.
    """
    model, table, a, b = train(docs, labels)
    scored = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_strengths(model, table), "doc_id long, strength double")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("strength") + F.lit(b))))
    out = scored.select("doc_id", (fold() == 1).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with ``columns`` (``text`` among them or not).

    Each row is judged by its own text as it passes, so nothing is joined or shuffled after training, and rows of null or
    repeated doc_id are judged like others. Null and empty texts stay. Empty input gives an empty result.
    """
    model, table, a, b = train(docs, labels)
    others = [c for c in columns if c != "text"]
    given = docs.select("text", *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    first = 0 if "text" in columns else 1
    schema = StructType([*given.schema.fields[first:], StructField("strength", DoubleType())])
    scored = given.mapInArrow(_strengths(model, table, first), schema)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("strength") + F.lit(b))))
    return scored.where(score < threshold).select(*("text" if c == "text" else F.col(f"c{others.index(c)}").alias(c) for c in columns))
