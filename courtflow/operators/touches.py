"""ST6, A35: who holds the ball, as far as boxes tell: candidates for review, part seen and part filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions import exprs as X

#: Reach and margin in body heights, least held frames and longest gap of a touch, least confidence of a ball.
HOLD, MARGIN, LEAST_FRAMES, MOST_GAP, BALL_CONF = 0.30, 0.15, 6, 8, 0.10


def ball_places(ball: DataFrame, least: float = BALL_CONF) -> DataFrame:
    """(clip_id, frame, cx, cy): the surest detection of each frame, the first on a tie."""
    good = ball.where(F.col("conf") >= least)
    best = good.groupBy("clip_id", "frame").agg(F.max_by(F.struct("cx", "cy"), F.struct("conf", -F.col("det_idx"))).alias("b"))
    return best.select("clip_id", "frame", "b.*")


def frame_holders(frames: DataFrame, tracks: DataFrame, ball: DataFrame, excluded: DataFrame, hold: float = HOLD, margin: float = MARGIN) -> DataFrame:
    """ST6, a row a frame: (clip_id, frame, verdict, track_id, reach).

    ``reach`` is the distance from the ball to the nearest body's box in heights of that body. no_ball: none was seen; too_far: nobody
    is within ``hold``; contested: the next body is less than ``margin`` further; else held by ``track_id``. ``excluded(clip_id, track_id)``
    (U1) hold nothing. Only frames of ``frames(clip_id, frame)`` are judged.
    """
    seen = ball_places(ball)
    bodies = tracks.where("track_id is not null and y2 > y1").join(excluded.select("clip_id", "track_id").distinct().hint("merge"), ["clip_id", "track_id"], "left_anti")
    reach = X.point_to_box("cx", "cy", "x1", "y1", "x2", "y2") / (F.col("y2") - F.col("y1"))
    near = bodies.join(seen.hint("merge"), ["clip_id", "frame"]).select("clip_id", "frame", "track_id", reach.alias("reach"))
    order = F.struct("reach", "track_id")
    two = near.groupBy("clip_id", "frame").agg(F.min(order).alias("a"), F.slice(F.array_sort(F.collect_list("reach")), 2, 1).alias("next"))
    met = frames.select("clip_id", "frame").distinct().join(seen.select("clip_id", "frame", F.lit(True).alias("_ball")).hint("merge"), ["clip_id", "frame"], "left").join(two.hint("merge"), ["clip_id", "frame"], "left")
    second = F.get("next", F.lit(0))
    verdict = (
        F.when(F.col("_ball").isNull(), "no_ball").when(F.col("a").isNull() | (F.col("a.reach") > hold), "too_far")
        .when(second - F.col("a.reach") < margin, "contested").otherwise("held")
    )
    told = met.withColumn("verdict", verdict)
    return told.select("clip_id", "frame", "verdict", F.when(F.col("verdict") == "held", F.col("a.track_id")).alias("track_id"), F.col("a.reach").alias("reach"))


def touches(holders: DataFrame, fps: float = 30.0, least: int = LEAST_FRAMES, gap: int = MOST_GAP) -> DataFrame:
    """ST6: (clip_id, touch, track_id, start_frame, end_frame, held_frames, span_frames, observed_seconds, inferred_seconds, total_seconds).

    Held frames of one track make a touch while at most ``gap`` frames lie between two of them and nobody else holds the ball;
    touches of fewer than ``least`` held frames are none. Held frames are seen, those between them are filled in.
    """
    w = Window.partitionBy("clip_id").orderBy("frame")
    held = holders.where("verdict = 'held'")
    new = F.coalesce((F.lag("track_id").over(w) != F.col("track_id")) | (F.col("frame") - F.lag("frame").over(w) - 1 > gap), F.lit(True))
    runs = held.withColumn("_s", F.sum(new.cast("int")).over(w)).groupBy("clip_id", "_s", "track_id").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("held_frames"))
    kept = runs.where(F.col("held_frames") >= least).withColumn("span_frames", F.col("end_frame") - F.col("start_frame") + 1)
    seconds = lambda n: F.bround(n / fps, 2)
    return kept.select(
        "clip_id", (F.row_number().over(Window.partitionBy("clip_id").orderBy("start_frame")) - 1).alias("touch"), "track_id", "start_frame", "end_frame", "held_frames", "span_frames",
        seconds(F.col("held_frames")).alias("observed_seconds"), seconds(F.col("span_frames") - F.col("held_frames")).alias("inferred_seconds"), seconds(F.col("span_frames")).alias("total_seconds"),
    )


def held_by(found: DataFrame, holders: DataFrame) -> DataFrame:
    """The held frames of each touch: (clip_id, touch, frame, track_id)."""
    held = holders.where("verdict = 'held'").select("clip_id", "frame", "track_id")
    spans = found.select("clip_id", "touch", "track_id", "start_frame", "end_frame")
    return held.join(spans.hint("merge"), ["clip_id", "track_id"]).where(F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).select("clip_id", "touch", "frame", "track_id")


def attributed_touches(found: DataFrame, holders: DataFrame, events: DataFrame, positions: DataFrame) -> DataFrame:
    """ST6 with identities and places: touches with ``identities``, ``number``, ``states``, ``frames_with_identity``, ``status``, start and end on court.

    ``events`` have ``number`` (J3). The number is the one that all numbered frames agree on, else null; ``status`` is always a review item,
    as a touch is inferred, or "no_identity_data" where no held frame has an event.
    """
    frames = held_by(found, holders)
    told = frames.join(events.select("clip_id", "frame", "track_id", "window", "identity_id", "state", "number").hint("merge"), ["clip_id", "frame", "track_id"], "left")
    states = told.where("state is not null").groupBy("clip_id", "touch", "state").agg(F.count(F.lit(1)).alias("n")).groupBy("clip_id", "touch").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("states"))
    who = told.groupBy("clip_id", "touch").agg(
        F.count_distinct(F.when(F.col("identity_id").isNotNull(), F.struct("window", "identity_id"))).alias("identities"), F.count("identity_id").alias("frames_with_identity"),
        F.when(F.min("number") == F.max("number"), F.min("number")).alias("number"),
    )
    at = positions.select("clip_id", "frame", "track_id", "court_x", "court_y")
    placed = frames.join(at.hint("merge"), ["clip_id", "frame", "track_id"])
    spot = F.struct("court_x", "court_y")
    ends = placed.groupBy("clip_id", "touch").agg(F.min_by(spot, "frame").alias("a"), F.max_by(spot, "frame").alias("b"))
    out = found
    for more in (who, states, ends):
        out = out.join(more.hint("merge"), ["clip_id", "touch"], "left")
    status = F.when(F.col("frames_with_identity") > 0, "review_item").otherwise("no_identity_data")
    return out.select(*found.columns, "identities", "number", "states", "frames_with_identity", status.alias("status"), F.col("a.court_x").alias("court_x"), F.col("a.court_y").alias("court_y"), F.col("b.court_x").alias("end_x"), F.col("b.court_y").alias("end_y"))


def touch_summary(attributed: DataFrame, length: float = 84.0) -> DataFrame:
    """(clip_id, n_touches, n_nameable, observed_seconds, inferred_seconds, pct_inferred, three, midrange, paint) by where touches start."""
    zone, _ = X.shot_zone("court_x", "court_y", length)
    rows = attributed.withColumn("zone", F.when(F.col("court_x").isNotNull(), zone))
    seen, filled = F.sum("observed_seconds"), F.sum("inferred_seconds")
    return rows.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_touches"), F.count("number").alias("n_nameable"), F.bround(seen, 1).alias("observed_seconds"), F.bround(filled, 1).alias("inferred_seconds"),
        F.bround(F.try_divide(100 * filled, seen + filled), 0).alias("pct_inferred"), *(F.count_if(F.col("zone") == z).alias(z) for z in ("three", "midrange", "paint")),
    )
