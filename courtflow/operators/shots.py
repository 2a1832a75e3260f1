"""Shots against identities, positions and the scoreboard.

Shots are ``(clip_id, shot_id, start_frame, end_frame, hoop, track_id)``; ``track_id`` is the shooter's at the release
frame, ``start_frame``, or null where no release was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHOT = ["clip_id", "shot_id"]


def shooters(shots: DataFrame, events: DataFrame) -> DataFrame:
    """The identity of each shooter at the release frame; of several events of a frame and track the last counts.

    ``events(clip_id, frame, track_id, event_ord, identity_id, state)``.
    """
    met = shots.select(*SHOT, F.col("start_frame").alias("frame"), "track_id").join(events, ["clip_id", "frame", "track_id"], "left")
    last = met.groupBy(*SHOT, "track_id").agg(F.max_by(F.struct("identity_id", "state"), "event_ord").alias("e"))
    status = (
        F.when(F.col("track_id").isNull(), "no_confident_shooter").when(F.col("e.identity_id").isNull(), "no_identity_data")
        .when(F.col("e.state") == "confirmed", "attributed").otherwise("review_item")
    )
    return last.select(*SHOT, "track_id", F.col("e.identity_id").alias("identity_id"), status.alias("status"))


def outside_span(shots: DataFrame, events: DataFrame) -> DataFrame:
    """Shots that start before or after all events of their clip, or whose clip has none: their shooters can't be told from these
    events, which are those of another span."""
    span = events.groupBy("clip_id").agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    met = shots.join(span.hint("merge"), "clip_id", "left")
    return met.where(~F.coalesce(F.col("start_frame").between(F.col("_a"), F.col("_b")), F.lit(False))).select(*SHOT)


def locations(shots: DataFrame, oncourt: DataFrame) -> DataFrame:
    """Where each shot was taken, or the first reason why that is unknown."""
    frames = oncourt.select("clip_id", F.col("frame").alias("start_frame"), F.lit(True).alias("_frame")).distinct()
    spots = oncourt.select("clip_id", F.col("frame").alias("start_frame"), "track_id", "court_x", "court_y", "is_on")
    met = shots.join(frames, ["clip_id", "start_frame"], "left").join(spots, ["clip_id", "start_frame", "track_id"], "left")
    reason = (
        F.when(F.col("track_id").isNull(), "no_release").when(F.col("_frame").isNull(), "frame_absent")
        .when(F.col("is_on").isNull(), "track_absent").when(~F.col("is_on"), "off_court")
    )
    here = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    return met.select(*SHOT, F.coalesce(reason, F.lit("located")).alias("status"), here("court_x"), here("court_y"))


def _scores_within(spans: DataFrame, scores: DataFrame, width: int) -> DataFrame:
    """Scores with ``lo <= frame < hi`` of each span of at most ``width`` frames: an equi-join on blocks of frames."""
    block = lambda c: F.floor(c / F.lit(width))
    wide = spans.withColumn("_k", F.explode(F.sequence(block(F.col("lo")), block(F.greatest("lo", F.col("hi") - 1)))))
    dealt = scores.select("clip_id", F.col("frame").alias("score_frame"), block(F.col("frame")).alias("_k"))
    return wide.hint("merge").join(dealt, ["clip_id", "_k"]).where("score_frame >= lo and score_frame < hi")


def made_nearby(shots: DataFrame, scores: DataFrame, frames: int) -> DataFrame:
    """A shot is made if the score changes within ``frames`` after its end, both ends included."""
    spans = shots.select(*SHOT, F.col("end_frame").alias("lo"), (F.col("end_frame") + frames + 1).alias("hi"))
    n = _scores_within(spans, scores, frames + 1).groupBy(*SHOT).agg(F.count(F.lit(1)).alias("changes"))
    return shots.select(*SHOT).join(n, SHOT, "left").select(*SHOT, F.coalesce("changes", F.lit(0).cast("long")).alias("changes")).withColumn("made", F.col("changes") > 0)


def first_change(shots: DataFrame, scores: DataFrame, frames: int = 180) -> DataFrame:
    """The first score change from a shot's end until the next shot starts, ``frames`` at most."""
    w = Window.partitionBy("clip_id").orderBy("start_frame", "shot_id")
    until = F.least(F.col("end_frame") + frames, F.lead("start_frame").over(w))  # least skips nulls
    spans = shots.select(*SHOT, F.col("end_frame").alias("lo"), until.alias("hi"))
    first = _scores_within(spans.where("hi > lo"), scores, frames).groupBy(*SHOT).agg(F.min("score_frame").alias("score_frame"))
    return spans.join(first, SHOT, "left").select(*SHOT, F.col("hi").alias("window_end"), "score_frame", F.col("score_frame").isNotNull().alias("made"))


def reproduced(verified: DataFrame, claimed: DataFrame, slack: int = 10) -> DataFrame:
    """Claims at the same hoop whose both ends lie within ``slack`` frames of each verified shot."""
    near = (F.abs(F.col("s") - F.col("start_frame")) <= slack) & (F.abs(F.col("e") - F.col("end_frame")) <= slack)
    size = 2 * slack + 1  # starts within slack of each other lie in the same block or in neighbouring ones
    block = F.floor(F.col("start_frame") / size)
    other = claimed.select("clip_id", "hoop", F.col("start_frame").alias("s"), F.col("end_frame").alias("e"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    hits = verified.withColumn("block", block).hint("merge").join(other, ["clip_id", "hoop", "block"]).where(near).groupBy(*SHOT).agg(F.count(F.lit(1)).alias("hits"))
    return verified.select(*SHOT).join(hits, SHOT, "left").select(*SHOT, F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def unseen_frames(spans: DataFrame, dets: DataFrame, conf: float = 0.10) -> DataFrame:
    """Frames within flights without a detection of at least ``conf``."""
    frames = spans.select("clip_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).distinct()
    return frames.hint("merge").join(dets.where(F.col("conf") >= conf).select("clip_id", "frame"), ["clip_id", "frame"], "left_anti")


def falls_below_rim(shots: DataFrame, dets: DataFrame, hoops: DataFrame, window: int = 15, corridor: float = 50.0, jitter: float = 5.0, least: int = 3) -> DataFrame:
    """Detections below the rim after a shot's end, kept where at least ``least`` of them never rise by over ``jitter``.

    ``hoops(clip_id, frame, hoop, hx, hy)``; frames without the hoop are skipped.
    """
    after = shots.select(*SHOT, "hoop", F.explode(F.sequence(F.col("end_frame") + 1, F.col("end_frame") + window)).alias("frame"))
    below = after.hint("merge").join(hoops, ["clip_id", "frame", "hoop"]).hint("merge").join(dets, ["clip_id", "frame"]).where((F.abs(F.col("cx") - F.col("hx")) <= corridor) & (F.col("cy") > F.col("hy")))
    w = Window.partitionBy(*SHOT).orderBy("frame", "det_idx")
    falling = F.coalesce(F.col("cy") >= F.lag("cy").over(w) - jitter, F.lit(True))
    runs = below.withColumn("falling", falling).groupBy(*SHOT).agg(F.count(F.lit(1)).alias("points"), F.bool_and("falling").alias("falling"))
    return runs.where((F.col("points") >= least) & F.col("falling")).drop("falling")


def distribution(zones: DataFrame) -> DataFrame:
    """Shots and percentages of each zone by clip; percentages to one decimal."""
    n = [F.count_if(F.col("zone") == z).alias(z) for z in ("three", "midrange", "paint")]
    counts = zones.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), *n)
    pct = lambda z: F.bround(100.0 * F.col(z) / F.col("n"), 1)
    return counts.withColumns({"pct_three": pct("three"), "pct_two": F.bround(pct("midrange") + pct("paint"), 1)})


def near_hoop(tracks: DataFrame, hoops: DataFrame, radius: float) -> DataFrame:
    """Boxes whose foot point lies within ``radius`` px of any hoop of the frame."""
    spots = hoops.select("clip_id", "frame", "hx", "hy")
    x, y = (F.col("x1") + F.col("x2")) / 2 - F.col("hx"), F.col("y2") - F.col("hy")
    same = (tracks.clip_id == spots.clip_id) & (tracks.frame == spots.frame)
    return tracks.join(spots.hint("merge"), same & (x * x + y * y <= radius * radius), "left_semi")


def contained(spans: DataFrame, shots: DataFrame, slack: int = 5, size: int = 256) -> DataFrame:
    """For each span that is no shot, (clip_id, span_id, inside): whether a shot lies within it, ends widened by ``slack``."""
    blocks = spans.withColumn("block", F.explode(F.sequence(F.floor((F.col("start_frame") - slack) / size), F.floor((F.col("end_frame") + slack) / size))))
    at = shots.select("clip_id", F.col("start_frame").alias("s"), F.col("end_frame").alias("e"), F.floor(F.col("start_frame") / size).alias("block"))
    met = blocks.hint("merge").join(at, ["clip_id", "block"]).where((F.col("s") >= F.col("start_frame") - slack) & (F.col("e") <= F.col("end_frame") + slack))
    return spans.select("clip_id", "span_id").join(met.select("clip_id", "span_id", F.lit(True).alias("inside")).distinct(), ["clip_id", "span_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
