"""Ball flight: chains, arcs, shot attempts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the chaining and physics gates (pixels, frames).
STEP, HOLE, MIN_CHAIN, MIN_TRAVEL, MIN_FIT = 40.0, 3, 6, 30.0, 8
ACCEL_Y, ACCEL_X, RMS, Y_RANGE = (0.3, 3.0), 1.5, 3.0, 25.0
HOOP_RADIUS, FORWARD = 125.0, 15

_CHAINS = "clip_id long, island long, chain long, place int, frame long, cx double, cy double, conf double"


def chain_points(dets: DataFrame) -> DataFrame:
    """ST3: detections linked into chains, nearest prediction first.

    ``dets(clip_id, frame, det_idx, cx, cy, conf)``. No chain survives a hole over ``HOLE`` frames, so clips part at such holes into
    islands, and the greedy fold runs per island. A chain is (clip_id, island, chain).
    """
    w = Window.partitionBy("clip_id").orderBy("frame", "det_idx")
    cut = F.coalesce((F.col("frame") - F.lag("frame").over(w) > HOLE + 1).cast("long"), F.lit(0))
    rows = dets.withColumn("island", F.sum(cut).over(w))

    def link(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["frame", "det_idx"], kind="stable").reset_index(drop=True)
        at = p.frame.to_numpy()
        spot = p[["cx", "cy"]].to_numpy()
        owner = np.empty(len(p), np.int64)
        # of each chain: frame, place and speed at its last point; one row a chain, at most one a detection
        last, place, speed = np.full(len(p), -(1 << 40)), np.zeros((len(p), 2)), np.zeros((len(p), 2))
        made = 0
        for rows in np.split(np.arange(len(p)), np.flatnonzero(np.diff(at)) + 1):
            frame = at[rows[0]]
            open_ = np.flatnonzero(frame - last[:made] <= HOLE + 1)
            wait = (frame - last[open_])[:, None]
            away = np.linalg.norm(spot[rows][None] - (place[open_] + speed[open_] * wait)[:, None], axis=2)
            away[away > STEP * wait] = np.inf
            chosen = np.full(len(rows), -1)
            while away.size and np.isfinite(away.min()):  # nearest pair first; then neither takes part any more
                c, d = np.unravel_index(np.argmin(away), away.shape)
                chosen[d] = open_[c]
                away[c], away[:, d] = np.inf, np.inf
            fresh = chosen < 0
            chosen[fresh] = made + np.arange(fresh.sum())
            made += int(fresh.sum())
            for c, r, new in zip(chosen, rows, fresh):
                if not new:
                    speed[c] = (spot[r] - place[c]) / max(frame - last[c], 1)
                last[c], place[c] = frame, spot[r]
            owner[rows] = chosen
        out = p.assign(chain=owner)
        out["place"] = out.groupby("chain").cumcount().astype("int32")
        return out[[c.split()[0] for c in _CHAINS.split(", ")]]

    return rows.select("clip_id", "island", "frame", "det_idx", "cx", "cy", "conf").groupBy("clip_id", "island").applyInPandas(link, _CHAINS)


_FACTS = ["accel_y", "accel_x", "rms_y", "rms_x", "fit_x", "fit_y"]
#: Bounds of the robust fit: share of a chain's points and number of them that may be left out, and how many more are candidates.
DROP_SHARE, DROPS, SPARE = 0.25, 4, 3


def _fits(t: np.ndarray, x: np.ndarray, y: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, list]:
    """Quadratics through several selections of points at once: (which pass the physics gates, facts of each).

    ``take`` has a row of 0/1 a selection. Sums of powers of time give all normal equations; residuals come from them too.
    """
    first = np.where(take > 0, t, np.inf).min(1)
    rel = (t[None] - first[:, None]) * take
    n = take.sum(1)
    power = [np.where(take > 0, rel, 0.0) ** k * take for k in range(5)]
    s = [q.sum(1) for q in power]
    left = np.array([[s[4], s[3], s[2]], [s[3], s[2], s[1]], [s[2], s[1], s[0]]]).transpose(2, 0, 1)
    coef, rms = [], []
    for v in (x, y):
        right = np.stack([(power[k] * v).sum(1) for k in (2, 1, 0)], 1)
        c = np.linalg.solve(left, right[..., None])[..., 0]
        off = (c[:, :1] * rel**2 + c[:, 1:2] * rel + c[:, 2:] - v) * take
        coef.append(c)
        rms.append(np.sqrt((off**2).sum(1) / n))
    drop = np.where(take > 0, y, -np.inf).max(1) - np.where(take > 0, y, np.inf).min(1)
    ay, ax = 2 * coef[1][:, 0], 2 * coef[0][:, 0]
    ok = (ay >= ACCEL_Y[0]) & (ay <= ACCEL_Y[1]) & (np.abs(ax) <= ACCEL_X) & (rms[1] <= RMS) & (rms[0] <= RMS) & (drop >= Y_RANGE)
    return ok, [(*map(float, f[:4]), f[4].tolist(), f[5].tolist()) for f in zip(ay, ax, rms[1], rms[0], *coef)]


def _grown(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, tuple | None]:
    """Points of the longest unbroken row of passing prefixes, from ``MIN_FIT`` points on, with its facts; in blocks of ends."""
    best, facts = 0, None
    for lo in range(MIN_FIT, len(t) + 1, 32):
        ends = np.arange(lo, min(lo + 32, len(t) + 1))
        m = ends[-1]
        ok, every = _fits(t[:m], x[:m], y[:m], (np.arange(m)[None] < ends[:, None]).astype(float))
        passed = len(ok) if ok.all() else int(np.argmin(ok))
        if passed:
            best, facts = int(ends[passed - 1]), every[passed - 1]
        if passed < len(ok):
            break
    return best, facts


def _rescued(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, tuple] | None:
    """ST5: the whole chain but for a few points: the fewest, and of those the ones that lie farthest from the plain fit."""
    n = len(t)
    budget = min(int(np.ceil(n * DROP_SHARE)), DROPS, n - MIN_FIT)
    if budget < 1:
        return None
    _, plain = _fits(t, x, y, np.ones((1, n)))
    rel = t - t[0]
    off = (np.polyval(plain[0][4], rel) - x) ** 2 + (np.polyval(plain[0][5], rel) - y) ** 2
    pool = np.argsort(-off, kind="stable")[: budget + SPARE]
    out = [c for k in range(1, budget + 1) for c in combinations(range(len(pool)), k)]
    take = np.ones((len(out), n))
    for row, c in zip(take, out):
        row[pool[list(c)]] = 0
    ok, every = _fits(t, x, y, take)
    if not ok.any():
        return None
    k = int(np.argmax(ok))
    return take[k] > 0, every[k]


_ARCS = "clip_id long, island long, chain long, arc int, start_frame long, end_frame long, n_points int, accel_y double, accel_x double, rms_y double, rms_x double, fit_x array<double>, fit_y array<double>, n_dropped int"


def arcs(points: DataFrame) -> DataFrame:
    """ST4, ST5, A19: flights of each chain: maximal passing segments, left to right; neighbours a short hole apart that pass as one
    are one. A chain without any may pass as a whole but for a few points (``n_dropped``).

    Chains under ``MIN_CHAIN`` points or ``MIN_TRAVEL`` pixels claim nothing.
    """

    def fly(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame", kind="stable")
        f, x, y = (p[c].to_numpy(float) for c in ("frame", "cx", "cy"))
        found: list[tuple[int, int, int, tuple, int]] = []  # first, last and number of points, facts, points left out
        if len(f) >= max(MIN_CHAIN, MIN_FIT) and np.hypot(np.ptp(x), np.ptp(y)) >= MIN_TRAVEL:
            at = 0
            while len(f) - at >= MIN_FIT:
                n, facts = _grown(f[at:], x[at:], y[at:])
                if not n:
                    at += 1
                    continue
                seg = (at, at + n - 1, n, facts, 0)
                if found and f[at] - f[found[-1][1]] <= HOLE + 1:
                    a, b = found[-1][0], at + n
                    ok, joint = _fits(f[a:b], x[a:b], y[a:b], np.ones((1, b - a)))
                    if ok[0]:
                        found.pop()
                        seg = (a, b - 1, b - a, joint[0], 0)
                found.append(seg)
                at = seg[1] + 1
            if not found and (saved := _rescued(f, x, y)):
                kept = np.flatnonzero(saved[0])
                found = [(kept[0], kept[-1], len(kept), saved[1], len(f) - len(kept))]
        head = (p.clip_id.iloc[0], p.island.iloc[0], p.chain.iloc[0])
        rows = [(*head, m, int(f[a]), int(f[b]), n, *facts, gone) for m, (a, b, n, facts, gone) in enumerate(found)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ARCS.split(", ")])

    def fly_all(p: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fly(g) for _, g in p.groupby("chain")])

    return points.select("clip_id", "island", "chain", "frame", "cx", "cy").groupBy("clip_id", "island").applyInPandas(fly_all, _ARCS)  # an island's chains in one batch


def chain_verdicts(points: DataFrame, found: DataFrame) -> DataFrame:
    """too_short, static_junk, arc or no_claim for each chain."""
    key = ["clip_id", "island", "chain"]
    span = F.sqrt(F.pow(F.max("cx") - F.min("cx"), 2) + F.pow(F.max("cy") - F.min("cy"), 2))
    chains = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), span.alias("travel"))
    out = chains.hint("merge").join(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n_arcs")), key, "left")
    verdict = F.when(F.col("n_points") < MIN_CHAIN, "too_short").when(F.col("travel") < MIN_TRAVEL, "static_junk").when(F.col("n_arcs") > 0, "arc").otherwise("no_claim")
    return out.withColumn("verdict", verdict).withColumn("n_arcs", F.coalesce("n_arcs", F.lit(0)))


def shot_attempts(found: DataFrame, points: DataFrame, hoops: DataFrame, radius: float = HOOP_RADIUS, forward: int = FORWARD) -> DataFrame:
    """H1, T5: each arc against both hoops, the better verdict kept.

    The closest observed approach within ``radius`` counts, else the fit carried on by up to ``forward`` frames, falling part
    only. Flights that begin near a hoop must also arrive (layup) or are deflections. Frames without a hoop are skipped.
    """
    key = ["clip_id", "island", "chain", "arc"]
    dist = F.sqrt(F.pow(F.col("x") - F.col("hx"), 2) + F.pow(F.col("y") - F.col("hy"), 2))
    base = found.select(*key, "start_frame", "end_frame", "fit_x", "fit_y")
    seen = base.hint("merge").join(points.select("clip_id", "island", "chain", "frame", F.col("cx").alias("x"), F.col("cy").alias("y")), ["clip_id", "island", "chain"]).where("frame between start_frame and end_frame")
    at = seen.hint("merge").join(hoops, ["clip_id", "frame"]).withColumn("d", dist)
    near = at.groupBy(*key, "hoop").agg(
        F.min(F.struct("d", "frame")).alias("obs"), F.max(F.when(F.col("frame") == F.col("start_frame"), F.col("d"))).alias("origin"), F.max(F.when(F.col("frame") == F.col("end_frame"), F.col("d"))).alias("ending")
    )
    ahead = base.withColumn("frame", F.explode(F.sequence(F.col("end_frame"), F.col("end_frame") + forward))).withColumn("t", (F.col("frame") - F.col("start_frame")).cast("double"))
    coef = [[F.get(c, F.lit(i)) for i in range(3)] for c in ("fit_x", "fit_y")]
    apex = F.when(coef[1][0] > 0, -coef[1][1] / (2 * coef[1][0])).otherwise(F.lit(0.0))
    carried = ahead.where(F.col("t") >= apex).withColumns({n: c[0] * F.col("t") * F.col("t") + c[1] * F.col("t") + c[2] for n, c in zip("xy", coef)})
    further = carried.hint("merge").join(hoops, ["clip_id", "frame"]).withColumn("d", dist).groupBy(*key, "hoop").agg(F.min(F.struct("d", "frame")).alias("ext"))
    hoop_names = hoops.select("clip_id", "hoop").distinct()
    both = base.select(*key, "start_frame", "end_frame").join(hoop_names.hint("merge"), "clip_id").join(near.hint("merge"), [*key, "hoop"], "left").join(further.hint("merge"), [*key, "hoop"], "left")
    seen_ok = F.coalesce(F.col("obs.d") <= radius, F.lit(False))
    use_ext = ~seen_ok & F.col("ext").isNotNull() & F.coalesce(F.col("ext.d") < F.col("obs.d"), F.lit(True))
    both = both.withColumn("best", F.when(use_ext, F.col("ext")).otherwise(F.col("obs"))).withColumn("arrival", F.when(F.col("best").isNotNull(), F.when(use_ext, "extrapolated").otherwise("observed")))
    reaches = F.coalesce(F.col("best.d") <= radius, F.lit(False))
    starts_near = F.coalesce(F.col("origin") <= radius, F.lit(False))
    arrived = use_ext | F.coalesce(F.col("ending") <= radius, F.lit(False))
    verdict = F.when(reaches & (~starts_near | (F.col("arrival") == "extrapolated") | arrived), "shot_attempt").otherwise("not_shot")
    reason = F.when(~reaches, "never reaches the hoop region").when(verdict == "not_shot", "starts near the hoop and leaves it")
    told = both.select(*key, "hoop", "start_frame", "end_frame", verdict.alias("verdict"), reason.alias("reason"), F.when(verdict == "shot_attempt", F.when(starts_near, "layup").otherwise("jumpshot")).alias("shot_type"), "arrival", F.bround("best.d", 1).alias("min_dist"), F.col("best.frame").alias("at_frame"))
    w = Window.partitionBy(*key).orderBy((F.col("verdict") == "shot_attempt").desc(), F.col("min_dist").asc_nulls_last(), "hoop")
    return told.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apexes(found: DataFrame, points: DataFrame) -> DataFrame:
    """The highest point of each arc, the first on a tie."""
    key = ["clip_id", "island", "chain"]
    seen = found.select(*key, "arc", "start_frame", "end_frame").hint("merge").join(points, key).where("frame between start_frame and end_frame")
    return seen.groupBy(*key, "arc").agg(F.min_by("frame", F.struct("cy", "frame")).alias("apex_frame"), F.min("cy").alias("apex_y"))


def releases(shots: DataFrame, points: DataFrame, tracks: DataFrame, back: int = 10, radius: float = 120.0) -> DataFrame:
    """The body nearest to a flight's extension backwards, over 10 frames; ties to the later frame, then the earlier track.

    ``shots`` needs (clip_id, start_frame, fit_x, fit_y); bodies beyond ``radius`` don't count (no row).
    """
    k = shots.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(back)))).withColumn("frame", F.col("start_frame") - F.col("k"))
    xy = {n: F.get(c, F.lit(0)) * F.col("k") * F.col("k") - F.get(c, F.lit(1)) * F.col("k") + F.get(c, F.lit(2)) for n, c in (("bx", "fit_x"), ("by", "fit_y"))}
    met = k.withColumns(xy).hint("merge").join(tracks, ["clip_id", "frame"])
    dx = F.greatest(F.col("x1") - F.col("bx"), F.lit(0.0), F.col("bx") - F.col("x2"))
    dy = F.greatest(F.col("y1") - F.col("by"), F.lit(0.0), F.col("by") - F.col("y2"))
    near = met.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)
    best = near.groupBy("clip_id", "start_frame").agg(F.min(F.struct("d", "k", "track_pos", "track_id", "frame")).alias("b"))
    return best.select("clip_id", "start_frame", F.col("b.track_id").alias("track_id"), F.col("b.frame").alias("release_frame"), F.col("b.d").alias("dist"))
