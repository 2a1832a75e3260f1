"""Data-quality reports, sampling and frame selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.operators.colors import nearest_team


def _track_order():
    return Window.partitionBy("clip_id", "track_id").orderBy("frame")


def fragmentation(tracks: DataFrame) -> DataFrame:
    """Distinct tracks, mean tracks a frame, mean lifespan in frames."""
    per_frame = tracks.groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n")).groupBy("clip_id").agg(F.avg("n").alias("tracks_per_frame"))
    lives = tracks.groupBy("clip_id", "track_id").agg(F.count(F.lit(1)).alias("n")).groupBy("clip_id").agg(F.count(F.lit(1)).alias("ids"), F.avg("n").alias("lifespan"))
    return lives.join(per_frame, "clip_id")


def reattach_gaps(tracks: DataFrame, least: int = 3) -> DataFrame:
    """Silences of at least ``least`` frames within a track."""
    gap = F.col("frame") - F.lag("frame").over(_track_order()) - 1
    return tracks.select("clip_id", "track_id", "frame", gap.alias("gap")).where(F.col("gap") >= least)


def reattach_verdicts(silences: DataFrame, crops: DataFrame, centroids: DataFrame, group: str = "team_hint", margin: float = 1.4) -> DataFrame:
    """The silences of ``reattach_gaps`` with the team by colour in the last frame before and the first one after, and a verdict.

    ``crops(clip_id, frame, track_id, c0, c1, c2)``, ``centroids`` of teams (A12). safe: both are of one team; suspect: of two; abstain:
    one of them has no crop or no clear team.
    """
    key = ["clip_id", "frame", "track_id"]
    ends = silences.select("clip_id", "track_id", "frame", "gap", (F.col("frame") - F.col("gap") - 1).alias("_last"))
    asked = ends.select(*key).unionByName(ends.select("clip_id", F.col("_last").alias("frame"), "track_id")).distinct()
    told = nearest_team(crops.join(asked.hint("merge"), key, "left_semi"), centroids, group, margin, key).select(*key, "team")
    before = told.select("clip_id", F.col("frame").alias("_last"), "track_id", F.col("team").alias("before"))
    met = ends.join(before.hint("merge"), ["clip_id", "_last", "track_id"], "left").join(told.withColumnRenamed("team", "after").hint("merge"), key, "left")
    verdict = F.when(F.col("before").isNull() | F.col("after").isNull(), "abstain").when(F.col("before") == F.col("after"), "safe").otherwise("suspect")
    return met.select("clip_id", "track_id", "frame", "gap", "before", "after", verdict.alias("verdict"))


def harvest_frames(tracks: DataFrame, spans: DataFrame, k: int = 60) -> DataFrame:
    """The ``k`` fullest frames of each clip and all frames of known ``spans(clip_id, start_frame, end_frame)``, once each."""
    known = spans.select("clip_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return densest_frames(tracks, k).select("clip_id", "frame").unionByName(known).distinct()


def tallies(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each state."""
    return rows.groupBy("clip_id", column).agg(F.count(F.lit(1)).alias("n"))


def densest_frames(tracks: DataFrame, k: int = 60) -> DataFrame:
    """The k fullest frames of each clip, the earlier on a tie."""
    counts = tracks.groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("clip_id").orderBy(F.desc("n"), "frame")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def step_profile(positions: DataFrame) -> DataFrame:
    """Median, 95th percentile and largest step of each track from frame to frame, by clip."""
    dx, dy = F.col("court_x") - F.lag("court_x").over(_track_order()), F.col("court_y") - F.lag("court_y").over(_track_order())
    steps = positions.withColumn("step", F.sqrt(dx * dx + dy * dy)).where("step is not null")
    return steps.groupBy("clip_id").agg(F.percentile("step", F.lit(0.5)).alias("median"), F.percentile("step", F.lit(0.95)).alias("p95"), F.max("step").alias("longest"))


def nearest_keyframe(frames: DataFrame, keyframes: DataFrame) -> DataFrame:
    """The keyframe nearest to each frame, the lower on a tie; one sorted pass per clip."""
    both = frames.select("clip_id", "frame").distinct().withColumn("kf", F.lit(None).cast("long")).unionByName(keyframes.select("clip_id", F.col("keyframe").alias("frame"), F.col("keyframe").alias("kf")).distinct())
    w = Window.partitionBy("clip_id").orderBy("frame")
    back = F.last("kf", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("kf", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    out = both.withColumn("lo", back).withColumn("hi", ahead).where("kf is null")
    use_hi = F.col("lo").isNull() | (F.col("hi") - F.col("frame") < F.col("frame") - F.col("lo"))
    return out.select("clip_id", "frame", F.when(use_hi, F.col("hi")).otherwise(F.col("lo")).alias("keyframe"))


def spread_sample(rows: DataFrame, keys: list[str], order: str, cap: int = 6) -> DataFrame:
    """At most ``cap`` rows of each key, evenly spread over the sorted distinct values."""
    w = Window.partitionBy(*keys)
    told = rows.select(*keys, order).distinct().withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    chosen = F.exists(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.floor(k * F.col("n") / F.lit(cap)) == F.col("i"))
    return told.where((F.col("n") <= cap) | chosen).select(*keys, order)


def tallest_crops(tracks: DataFrame, height: float = 90.0, slices: int = 6) -> DataFrame:
    """The tallest box of each sixth of a track's boxes of at least ``height`` px, the first on a tie."""
    h = F.col("y2") - F.col("y1")
    good = tracks.withColumn("h", h).where(F.col("h") >= height)
    w = Window.partitionBy("clip_id", "track_id")
    good = good.withColumn("i", F.row_number().over(w.orderBy("frame")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    part = F.floor(F.col("i") / F.greatest(F.floor(F.col("n") / slices), F.lit(1)))
    return good.groupBy("clip_id", "track_id", part.alias("slice")).agg(F.max_by(F.struct("frame", "h"), F.struct("h", -F.col("frame"))).alias("b")).select("clip_id", "track_id", "slice", F.col("b.frame").alias("frame"), F.col("b.h").alias("h"))


def seen_profile(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """Frames with a detection, mean detections a frame, and flips between seen and unseen."""
    counts = frames.select("clip_id", "frame").distinct().join(dets.groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n")), ["clip_id", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("clip_id").orderBy("frame")
    flip = (F.col("n") > 0) != (F.lag("n").over(w) > 0)
    marked = counts.withColumn("flip", F.coalesce(flip.cast("int"), F.lit(0)))
    return marked.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("n") > 0).alias("seen"), F.sum("n").alias("dets"), F.sum("flip").alias("flips"))


def misaligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames that only one of two streams has."""
    left = a.select("clip_id", "frame").distinct().withColumn("in_a", F.lit(True))
    right = b.select("clip_id", "frame").distinct().withColumn("in_b", F.lit(True))
    return left.join(right, ["clip_id", "frame"], "full").where("in_a is null or in_b is null").select("clip_id", "frame", F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("only_in"))


def sampled_frames(frames: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th frame number of a clip's range, marked where the clip lacks it."""
    span = frames.groupBy("clip_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    want = span.select("clip_id", F.explode(F.sequence("a", "b", F.lit(stride).cast("long"))).alias("frame"))
    return want.hint("merge").join(frames.select("clip_id", "frame", F.lit(True).alias("there")).distinct(), ["clip_id", "frame"], "left").withColumn("missing", F.col("there").isNull()).drop("there")


def debounced_scores(reads: DataFrame, memory: int = 7, votes: int = 4) -> DataFrame:
    """ST7: confirmed score changes: a value needs ``votes`` of the last ``memory`` reads and must not fall.

    ``reads(clip_id, frame, home, away)``; the first lock is a reading, not an event. Folds each clip's reads in order.
    """

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=["home", "away"]).sort_values("frame")
        pairs = list(zip(p.home.astype(int), p.away.astype(int)))
        changes, shown, since = [], None, 0  # since: the first read that still counts
        for i, frame in enumerate(p.frame):
            seen = pairs[max(since, i + 1 - memory) : i + 1]
            top = max(dict.fromkeys(seen), key=seen.count)  # the earliest seen wins a tie
            if seen.count(top) < votes or top == shown:
                continue
            since = i + 1
            if shown is not None and any(new < old for new, old in zip(top, shown)):
                continue
            if shown is not None:
                changes.append((p.clip_id.iloc[0], frame, *shown, *top))
            shown = top
        return pd.DataFrame(changes, columns=["clip_id", "frame", "from_home", "from_away", "to_home", "to_away"])

    return reads.groupBy("clip_id").applyInPandas(fold, "clip_id long, frame long, from_home long, from_away long, to_home long, to_away long")
