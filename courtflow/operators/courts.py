"""Which court is this? Marks of each keyframe are fitted to every known court; the best one is named only if it is clearly best."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Least marks of a keyframe (four fit any court), how much worse the next court must be, and the largest mean error in feet;
# a hoop's distance from its baseline and the radius of its arc.
LEAST_MARKS, DECISIVE, MOST_ERROR = 5, 1.35, 1.0
HOOP_X, ARC = 5.25, 19.75
COURT = "court string, length double, width double, lane_y0 double, lane_y1 double, ft_x double, circle_r double"


def court_tags(courts: DataFrame) -> DataFrame:
    """P25: (court, tag, court_x, court_y): where the 21 marks lie on each court (see ``COURT``)."""
    length, width, y0, y1, ft, r = (F.col(c) for c in ("length", "width", "lane_y0", "lane_y1", "ft_x", "circle_r"))
    zero, cx, cy = F.lit(0.0), length / 2, width / 2
    ends = {"LB": (zero, ft), "RB": (length, length - ft)}
    places = []
    for side, (base, line) in (("L", ends["LB"]), ("R", ends["RB"])):
        places += [(f"{side}B_side_near", base, zero), (f"{side}B_side_far", base, width)]
        places += [(f"{side}_{what}_{end}", x, y) for what, x in (("lane_base", base), ("FT", line)) for end, y in (("near", y0), ("far", y1))]
    places += [("center_near", cx, zero), ("center_logo", cx, cy), ("center_far", cx, width)]
    places += [("circle_top", cx, cy + r), ("circle_bottom", cx, cy - r), ("circle_left", cx - r, cy), ("circle_right", cx + r, cy)]
    places += [("L_arc_top", F.lit(HOOP_X + ARC), cy), ("R_arc_top", length - HOOP_X - ARC, cy)]
    rows = F.array(*(F.struct(F.lit(tag).alias("tag"), x.cast("double").alias("court_x"), y.cast("double").alias("court_y")) for tag, x, y in places))
    return courts.select("court", F.explode(rows).alias("p")).select("court", "p.*")


def _apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.concatenate((p, np.ones((*p.shape[:-1], 1))), axis=-1) @ np.swapaxes(h, -1, -2)
    return q[..., :2] / q[..., 2:]


def _scale(p: np.ndarray) -> np.ndarray:
    """The transforms that put points around the origin, at a mean distance of sqrt(2)."""
    mid = p.mean(1)
    far = np.sqrt(((p - mid[:, None]) ** 2).sum(2)).mean(1)
    s = np.where(far > 0, np.sqrt(2) / np.where(far > 0, far, 1.0), 1.0)
    out = np.zeros((len(p), 3, 3))
    out[:, 0, 0], out[:, 1, 1], out[:, 2, 2] = s, s, 1
    out[:, :2, 2] = -s[:, None] * mid
    return out


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solutions of all systems; NaN, which is no step, for singular ones alone."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full(b.shape, np.nan)
        half = len(a) // 2
        return np.concatenate((_solved(a[:half], b[:half]), _solved(a[half:], b[half:])))


def homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least-squares transforms of point sets (n, points, 2) to point sets, each by the singular vector of its normalised system,
    refined by Gauss-Newton steps on the distances in ``dst``; NaN where the points do not determine one."""
    a, b = _scale(src), _scale(dst)
    s, d = _apply(a, src), _apply(b, dst)
    rows = np.zeros((len(s), 2 * s.shape[1], 9))
    rows[:, 0::2, 0:2], rows[:, 0::2, 2], rows[:, 0::2, 6:8], rows[:, 0::2, 8] = s, 1, -d[..., :1] * s, -d[..., 0]
    rows[:, 1::2, 3:5], rows[:, 1::2, 5], rows[:, 1::2, 6:8], rows[:, 1::2, 8] = s, 1, -d[..., 1:] * s, -d[..., 1]
    _, values, v = np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)
    h = v[:, -1].reshape(-1, 3, 3)
    told = values[:, 7] >= 1e-9 * values[:, 0]
    live = np.flatnonzero(told & (np.abs(h[:, 2, 2]) >= 1e-12))  # the others of those told keep their singular vector
    h[live] /= h[live, 2:, 2:]
    error = lambda m, i: ((_apply(m, s[i]) - d[i]) ** 2).sum((1, 2))
    now, pull = np.zeros(len(s)), np.full(len(s), 1e-3)
    now[live] = error(h[live], live)
    for _ in range(30):
        if not len(live):
            break
        m, p, to = h[live], s[live], d[live]
        w = (p @ m[:, 2, :2, None])[..., 0] + 1
        got = _apply(m, p)
        j = np.zeros((len(live), 2 * p.shape[1], 8))
        j[:, 0::2, 0:2], j[:, 0::2, 2], j[:, 0::2, 6:8] = p / w[..., None], 1 / w, -got[..., :1] * p / w[..., None]
        j[:, 1::2, 3:5], j[:, 1::2, 5], j[:, 1::2, 6:8] = p / w[..., None], 1 / w, -got[..., 1:] * p / w[..., None]
        turned = np.swapaxes(j, 1, 2)
        normal = turned @ j
        eye = np.eye(8) * (np.diagonal(normal, axis1=1, axis2=2) + 1e-12)[:, None, :]
        step = _solved(normal + pull[live, None, None] * eye, turned @ (to - got).reshape(len(live), -1, 1))
        new = m + np.pad(step[..., 0], ((0, 0), (0, 1))).reshape(-1, 3, 3)
        after = error(new, live)
        better = after < now[live]
        done = better & (now[live] - after <= 1e-14 * now[live])
        up, down = live[~better], live[better]
        h[down], now[down] = new[better], after[better]
        pull[up] *= 10
        pull[down] /= 10
        live = live[np.where(better, ~done, pull[live] <= 1e6)]
    out = np.full((len(s), 3, 3), np.nan)
    out[told] = np.linalg.inv(b[told]) @ h[told] @ a[told]
    return out


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """``homographies`` of one point set; null where the points do not determine a transform."""
    h = homographies(np.asarray(src, float)[None], np.asarray(dst, float)[None])[0]
    return None if np.isnan(h).all() else h


def _left_over(px: pd.Series, py: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """The sum of the distances that each row's fit leaves; null where the points determine no transform. Rows of as many points are fitted at once."""
    size = px.map(len).to_numpy()
    out = np.full(len(px), np.nan)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        of = lambda c: np.stack([c.iloc[i] for i in at]).astype(float)
        src, dst = np.stack((of(px), of(py)), axis=2), np.stack((of(x), of(y)), axis=2)
        out[at] = np.linalg.norm(_apply(homographies(src, dst), src) - dst, axis=2).sum(1)
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def court_errors(marks: DataFrame, courts: DataFrame) -> DataFrame:
    """(clip_id, court, error_ft, marks, frames) for every clip and court: the mean distance that is left in feet.

    ``marks(clip_id, keyframe, tag, px, py)``. Each keyframe is fitted by itself to each court; keyframes of fewer than ``LEAST_MARKS``
    known marks, or whose marks determine no transform, don't count. error_ft is null where none counts. Courts are a handful,
    so they are sent to all tasks, each mark meets the place of its tag on each of them, and a row is one keyframe on one court.
    """
    tags = court_tags(courts)
    met = marks.repartition("clip_id", "keyframe").join(tags.hint("broadcast"), "tag").where("clip_id is not null and keyframe is not null")
    spots = F.array_sort(F.collect_list(F.struct("tag", *(F.col(c).cast("double").alias(c) for c in ("px", "py", "court_x", "court_y")))))
    sets = met.groupBy("clip_id", "keyframe", "court").agg(spots.alias("p")).where(F.size("p") >= LEAST_MARKS)
    total = F.pandas_udf(_left_over, "double")(*(F.col("p")[c] for c in ("px", "py", "court_x", "court_y")))
    fits = sets.select("clip_id", "court", F.size("p").cast("long").alias("n"), total.alias("total")).where("total is not null")
    sums = fits.groupBy("clip_id", "court").agg((F.sum("total") / F.sum("n")).alias("error_ft"), F.sum("n").alias("marks"), F.count(F.lit(1)).alias("frames"))
    # every clip meets every court: clips times a handful
    pairs = marks.select("clip_id").distinct().crossJoin(courts.select("court").hint("broadcast"))
    return pairs.join(sums.hint("merge"), ["clip_id", "court"], "left").fillna(0, ["marks", "frames"])


def identified_courts(errors: DataFrame) -> DataFrame:
    """(clip_id, identified, court, error_ft, marks, frames, runner_up, runner_up_error_ft, margin, reason), a row a clip.

    The court of the least error is identified if that is at most ``MOST_ERROR`` feet and the next one ``DECISIVE`` times as large.
    Without a keyframe that counts, with marks that fit no court, and on a tie the row abstains and says why.
    """
    w = Window.partitionBy("clip_id").orderBy(F.asc_nulls_last("error_ft"), "court")
    ranked = errors.withColumn("_r", F.row_number().over(w)).withColumn("runner_up", F.lead("court").over(w)).withColumn("runner_up_error_ft", F.lead("error_ft").over(w)).where("_r = 1")
    bare, poor = F.col("frames") == 0, F.col("error_ft") > MOST_ERROR
    margin = F.when(~bare & ~poor, F.col("runner_up_error_ft") / F.greatest("error_ft", F.lit(1e-9)))
    told = ranked.withColumn("margin", margin)
    reason = (
        F.when(bare, f"no keyframe has {LEAST_MARKS} marks or more").when(poor, F.format_string("no known court fits: the closest is off by %.2f ft", "error_ft"))
        .when(F.col("margin") < DECISIVE, F.format_string("too close to call between '%s' and '%s'", "court", "runner_up"))
    )
    named = ~bare & ~poor
    return told.select("clip_id", reason.isNull().alias("identified"), "court", "error_ft", "marks", "frames", F.when(named, F.col("runner_up")).alias("runner_up"), F.when(named, F.col("runner_up_error_ft")).alias("runner_up_error_ft"), "margin", reason.alias("reason"))


def court_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Courts from (court, length, width, lane_y0, lane_y1, ft_x, circle_r)."""
    return spark.createDataFrame(list(rows), COURT)
