"""Whitening of embeddings by a bidiagonal qd solver.

Centred rows are reduced to triangular blocks where they lie, blocks of blocks after them, until one triangle R is left: as large as
the dimension, however many rows there are. Householder reflections turn R into a bidiagonal B; dqds finds the squares of B's
singular values to high relative accuracy; a twisted factorisation of B'B - e for each of the largest gives its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import saved

#: Fixed values of the grid on which vectors are compared and added up exactly.
GRID, OFFSET = 64, 1_000_000
#: Entries from here on are dropped like infinite ones, as their products leave doubles' exact range.
TOO_LARGE = float(1 << 46)
#: Rows of a block, and triangles that are reduced together.
BLOCK = 2048
FAN_IN = 32
#: Vectors whose squared singular values differ by less than this share are made orthogonal to each other.
CLOSE = 1e-6
_EPS = np.finfo(float).eps
_LOW = 20  # bits of the lower half of an entry, which are added up apart


def gridded(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: vectors on the grid. Vectors that are null, hold null or non-finite entries (or ones of ``TOO_LARGE``), or are
    not as long as most (ties: the longer) are dropped."""
    v = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE)), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(whole)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform("v", lambda c: F.floor(c * float(GRID)) + OFFSET)
    return rows.where(F.size("v") == (sizes.d if sizes else 0)).select("vec_id", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


@dataclass(frozen=True)
class Sums:
    """What centring needs: rows, exact sums of each dimension and the largest absolute entry."""

    n: int
    s: tuple[int, ...]
    top: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: Python's integers where 64 bits might not do."""
        if self.n * self.top < 1 << 61:
            return x * self.n - np.array(self.s, np.int64)
        return x.astype(object) * self.n - np.array(self.s, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The sum of each row's squared deviations; null where it is beyond 64 bits."""
        d = self.deviations(x)
        if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 62:
            return (d * d).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in (sum(int(e) ** 2 for e in row) for row in d)]


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, hi, lo, top = 0, 0, 0, 0
    for b in batches:
        if len(b):
            x = matrix(b.column(0))
            n, hi, lo = n + len(x), hi + (x >> _LOW).sum(0), lo + (x & ((1 << _LOW) - 1)).sum(0)
            top = max(top, int(np.abs(x).max(initial=0)))
    d = len(hi) if n else 0
    yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "hi": pa.array(list(hi) if d else [], pa.int64()), "lo": pa.array(list(lo) if d else [], pa.int64()), "top": pa.array([top] * d, pa.int64())})


def sums(fit: DataFrame) -> Sums:
    """Exact sums over ``fit(x)``: a row a task and dimension is shuffled, a row a dimension comes here."""
    rows = fit.select("x").mapInArrow(_partial_sums, "i int, n long, hi long, lo long, top long")
    found = sorted(rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.max("top").alias("top")).collect())
    if not found:
        return Sums(0, (), 0)
    return Sums(found[0].n, tuple((r.hi << _LOW) + r.lo for r in found), max(r.top for r in found))


def triangle(fit: DataFrame, about: Sums) -> np.ndarray:
    """R with R'R = the sum of centred rows' outer products, by QR of blocks and of stacked triangles. ``about.n`` must not be 0."""
    d = len(about.s)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            x = matrix(b.column(0))
            for at in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack((r, about.centred(x[at : at + BLOCK]))), "r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, d))
        for one in p.r:
            r = np.linalg.qr(np.vstack((r, np.asarray(one).reshape(-1, d))), "r")
        return pd.DataFrame({"r": [r.ravel()]})

    left = saved(fit.select("x").mapInArrow(reduce, "r array<double>"))
    while (n := left.count()) > 1:
        # a row a task, then a group: their hashes deal them out
        left = saved(left.groupBy((F.xxhash64("r") % max(1, n // FAN_IN)).alias("g")).applyInPandas(merge, "r array<double>"))
    r = np.asarray(left.first().r).reshape(-1, d)
    return np.vstack((r, np.zeros((max(0, d - len(r)), d))))[:d]


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V) with r = U B V' by Householder reflections from both sides."""
    a, d = r.astype(float), r.shape[1]
    v = np.eye(d)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if len(x) < 2 or not np.linalg.norm(x[1:]):
            return None
        w = x.copy()
        w[0] += np.copysign(size, x[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := mirror(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < d - 2 and (w := mirror(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One dqds transform; the third is the first place whose pivot came out negative, or -1."""
    n, d = len(q), q[0] - shift
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if d < 0:
            return new_q, new_e, i
        new_q[i] = d + e[i]
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
    new_q[-1] = d
    return new_q, new_e, n - 1 if d < 0 else -1


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling.

    Each sweep takes a shift under the least value that is left: the least eigenvalue of the last two rows, or less where pivots
    turn negative; without a shift a sweep can't fail. Values leave at the end, the array splits where it falls apart.
    """
    tiny = _EPS * _EPS
    found: list[float] = []
    todo = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    sweeps, most = 0, 1000 * (len(diagonal) + 1)
    while todo:
        q, e, done = todo.pop()
        while q:
            if len(q) == 1:
                found.append(q[0] + done)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (done + q[i]) or e[i] <= tiny * (done + q[i + 1])), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], done))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # graded the wrong way: turn it round
                q, e = q[::-1], e[::-1]
            sweeps += 1
            if sweeps > most:
                raise RuntimeError("dqds did not settle")
            # the last two rows of the symmetric product, whose least eigenvalue is no less than the whole's
            a, c, b2 = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = (a + c) / 2
            shift = (a * c - b2) / (half + np.sqrt(max(0.0, ((a - c) / 2) ** 2 + b2))) * (1 - 4 * _EPS)
            shift = max(0.0, float(shift))
            for attempt in range(8):
                if attempt == 7:
                    shift = 0.0
                new_q, new_e, bad = _sweep(q, e, shift)
                if bad < 0:
                    break
                late = shift + new_q[-1] if bad == len(q) - 1 and attempt < 3 else 0.0
                shift = late if 0 < late < shift else shift / 4
            q, e, done = new_q, new_e, done + shift
    return np.sort(np.maximum(found, 0.0))[::-1]


def twisted(q: np.ndarray, low: np.ndarray, e: float) -> np.ndarray:
    """The unit vector of L D L' - e that is nearest singular (D = q, unit lower L = low), from the factorisation twisted at the place
    of the least pivot: the stationary one from above, the progressive one from below."""
    n, tiny = len(q), np.finfo(float).tiny ** 0.5
    plus, s = np.zeros(max(0, n - 1)), np.empty(n)
    s[0] = -e
    for i in range(n - 1):
        pivot = s[i] + q[i] or tiny
        plus[i] = q[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - e
    minus, p = np.zeros(max(0, n - 1)), np.empty(n)
    p[-1] = q[-1] - e
    for i in range(n - 2, -1, -1):
        pivot = q[i] * low[i] * low[i] + p[i + 1] or tiny
        t = q[i] / pivot
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - e
    at = int(np.argmin(np.abs(s + p + e)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def _vectors(q: np.ndarray, upper: np.ndarray, low: np.ndarray, squares: np.ndarray) -> list[np.ndarray]:
    """A vector for each of the falling ``squares`` of one unreduced block; close ones are made orthogonal, one that is lost in that
    comes from inverse iteration beside those found."""
    out: list[np.ndarray] = []
    full = None
    for k, e in enumerate(squares):
        z = twisted(q, low, e)
        near = [out[j] for j in range(k) if abs(squares[j] - e) <= CLOSE * squares[j]]
        if near:
            basis = np.array(near)
            rng = np.random.default_rng(k)
            for attempt in range(5):
                rest = z - basis.T @ (basis @ z)
                rest -= basis.T @ (basis @ rest)
                if np.linalg.norm(rest) > 0.1 * np.linalg.norm(z):
                    break
                if full is None:
                    full = np.diag(q + np.concatenate(([0.0], q[:-1] * low * low))) + np.diag(q[:-1] * low, 1) + np.diag(q[:-1] * low, -1)
                z = np.linalg.solve(full - e * (1 + 16 * _EPS * (attempt + 1)) * np.eye(len(q)), (w := rng.standard_normal(len(q))) - basis.T @ (basis @ w))
                z /= np.linalg.norm(z)
            z = rest / np.linalg.norm(rest)
        out.append(z)
    return out


def solve(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of the largest singular values of r, falling; their right vectors as columns).

    Values that can't be told from zero beside the largest are left out. A vector's largest entry is positive.
    """
    diagonal, upper, v = bidiagonal(r)
    d = len(diagonal)
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, upper = diagonal / size, upper / size
    diagonal = np.where(np.abs(diagonal) < _EPS, _EPS, diagonal)
    cuts = [0, *(np.flatnonzero(np.abs(upper) < _EPS) + 1), d]
    pairs: list[tuple[float, int, int, np.ndarray]] = []
    for a, b in zip(cuts, cuts[1:]):
        q, up = diagonal[a:b] ** 2, upper[a : b - 1]
        low = up / diagonal[a : b - 1]
        squares = dqds(diagonal[a:b], up)[:components]
        pairs += [(float(e), a, b, z) for e, z in zip(squares, _vectors(q, up, low, squares))]
    pairs.sort(key=lambda x: (-x[0], x[1]))
    pairs = [p for p in pairs[:components] if p[0] > (64 * d * _EPS) ** 2 * pairs[0][0]]
    out = np.zeros((d, len(pairs)))
    for k, (_, a, b, z) in enumerate(pairs):
        one = v[:, a:b] @ z
        out[:, k] = one * np.copysign(1.0, one[np.argmax(np.abs(one))])
    return np.array([p[0] for p in pairs]) * size * size, out


@dataclass(frozen=True)
class Model:
    """A fitted whitening. ``directions`` are the components divided by the roots of their eigenvalues."""

    sums: Sums
    eigenvalues: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def fit_whitening(fit: DataFrame, components: int = 16) -> Model:
    """The model of ``fit(x)``, distinct gridded vectors. No vectors, or only one, or none that differ: no components."""
    about = sums(fit)
    if not about.n or not about.s:
        return Model(about, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    r = triangle(fit, about)
    squares, v = solve(r, components)
    e = squares / about.n
    model = Model(about, e, v / np.sqrt(e), squares / max(np.square(r).sum(), np.finfo(float).tiny))
    return Model(about, e, model.directions, model.explained, identity_error(fit, model))


def identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance (divisor n, centred before multiplying) minus the identity."""
    k = model.directions.shape[1]
    if not k:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = model.sums.centred(matrix(b.column(0))) @ model.directions
            total += w.T @ w
            mean += w.sum(0)
        flat = np.concatenate((total.ravel(), mean))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat)), pa.int32()), "v": pa.array(flat)})

    rows = fit.select("x").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r.v for r in sorted(rows)]) / model.sums.n
    mean = flat[k * k :]  # rows are centred already: this is what rounding left
    return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, model: Model) -> DataFrame:
    """A row for each of ``rows(vec_id, x)`` and component; see ``_RESULT``."""
    k = model.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b) or not k:
                continue
            x = matrix(b.column(1))
            w = model.sums.centred(x) @ model.directions
            n = len(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column(0).take(pa.array(np.repeat(np.arange(n), k))), "component": pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), "n": pa.array(np.full(n * k, model.sums.n), pa.int64()),
                "deviation": pa.array(model.sums.squares(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(model.explained, n)), "identity_error": pa.array(np.full(n * k, model.identity_error)),
            })

    return rows.select("vec_id", "x").mapInArrow(run, _RESULT)


def whitening(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Whitened components of every usable row of ``vectors(vec_id, embedding)``, fitted on the distinct gridded vectors.

    Rows that ``gridded`` drops have no result; repeated rows and ids stay, as do null ids; other columns are ignored. Fewer components
    come out where the vectors span fewer dimensions, none for empty tables, vectors of no entries, or one distinct vector. deviation
    is null where it is beyond 64 bits.
    """
    rows = gridded(vectors)
    fit = saved(rows.select("x").distinct())
    return whitened(rows, fit_whitening(fit, components))
