"""Audits of identities, labels, resolutions and configuration. Every exclusion is counted or has a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ["clip_id", "window", "identity_id"]


def overlaps(candidates: DataFrame, credited: DataFrame, shown: int = 10) -> DataFrame:
    """Frames of each candidate identity in which its number is credited already: how many, and the first few."""
    met = candidates.join(credited.select("clip_id", "window", "number", "frame").distinct(), ["clip_id", "window", "number", "frame"], "left_semi")
    w = Window.partitionBy(*CHAIN, "number").orderBy("frame")
    ranked = met.select(*CHAIN, "number", "frame").distinct().withColumn("r", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.col("frame"))))
    return ranked.groupBy(*CHAIN, "number").agg(F.count(F.lit(1)).alias("frames"), first.alias("first_frames"))


def mixed_identities(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Per identity, its frames, tracks and labelled numbers; wrong if it spans two numbers. ``labels(clip_id, track_id, number)``."""
    met = events.join(labels, ["clip_id", "track_id"], "left")
    chains = met.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("number").alias("numbers"))
    return chains.withColumns({"judgeable": F.col("numbers") > 0, "wrong": F.col("numbers") > 1})


def worst_identities(events: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` wrong identities of each clip with most frames, ranked from 1; ties by window and identity."""
    wrong = mixed_identities(events, labels).where("wrong")
    w = Window.partitionBy("clip_id").orderBy(F.desc("frames"), "window", "identity_id")
    return wrong.select(*CHAIN, "frames", "tracks", "numbers", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def correctness(events: DataFrame, labels: DataFrame) -> DataFrame:
    """A28 by clip: judgeable and wrong identities, and whether the check can fire at all."""
    return mixed_identities(events, labels).groupBy("clip_id").agg(
        F.count_if("judgeable").alias("judgeable"), F.count_if("wrong").alias("wrong"),
        F.coalesce(F.sum(F.when(F.col("wrong"), F.col("frames"))), F.lit(0).cast("long")).alias("wrong_frames"), F.count_if(F.col("tracks") > 1).alias("can_fire"),
    )


def crowded_frames(named: DataFrame, most: int = 5) -> DataFrame:
    """Frames in which a team has over ``most`` named players. ``named(clip_id, frame, team, number)``."""
    return named.groupBy("clip_id", "frame", "team").agg(F.countDistinct("number").alias("players")).where(F.col("players") > most)


def readable_frames(events: DataFrame, oncourt: DataFrame, referees: DataFrame) -> DataFrame:
    """Events of tracks on court, without referees, by clip."""
    on = oncourt.where("is_on").select("clip_id", "frame", "track_id")
    kept = events.join(on, ["clip_id", "frame", "track_id"], "left_semi").join(referees, ["clip_id", "track_id"], "left_anti")
    return kept.groupBy("clip_id").agg(F.count(F.lit(1)).alias("readable"))


def rekeyed(resolutions: DataFrame, events: DataFrame) -> DataFrame:
    """The one track of each resolved identity; several make it ambiguous, none not found."""
    tracks = events.groupBy(*CHAIN).agg(F.countDistinct("track_id").alias("tracks"), F.min("track_id").alias("track_id"))
    met = resolutions.join(tracks, CHAIN, "left").withColumn("tracks", F.coalesce("tracks", F.lit(0).cast("long")))
    status = F.when(F.col("tracks") == 1, "migrated").when(F.col("tracks") > 1, "ambiguous").otherwise("not_found")
    return met.select(*CHAIN, "tracks", F.when(F.col("tracks") == 1, F.col("track_id")).alias("track_id"), status.alias("status"))


def resolved(resolutions: DataFrame, events: DataFrame) -> DataFrame:
    """The identity that a resolved track of a window has last in this run; refused where it has none."""
    last = events.groupBy("clip_id", "window", "track_id").agg(F.max_by("identity_id", F.struct("frame", "event_ord")).alias("identity_id"))
    met = resolutions.join(last, ["clip_id", "window", "track_id"], "left")
    return met.withColumn("status", F.when(F.col("identity_id").isNull(), "refused").otherwise("resolved"))


def seed_tracks(oncourt: DataFrame, votes: DataFrame) -> DataFrame:
    """Tracks in each window's first frame that the window's vote holds on court. ``oncourt`` has ``window``."""
    first = oncourt.withColumn("_f", F.min("frame").over(Window.partitionBy("clip_id", "window"))).where("frame = _f")
    on = votes.where("on_court").select("clip_id", "window", "track_id")
    return first.select("clip_id", "window", "track_id").distinct().join(on, ["clip_id", "window", "track_id"], "left_semi")


def scoreboard(digits: DataFrame, least: float = 0.15) -> DataFrame:
    """The two tallest digit boxes of a frame, left to right, or nulls unless both reach ``least``.

    ``digits(clip_id, frame, det_idx, cx, h, value, conf)``; of equal heights the earlier detection counts.
    """
    w = Window.partitionBy("clip_id", "frame").orderBy(F.desc("h"), "det_idx")
    two = digits.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("clip_id", "frame").agg(
        F.array_sort(F.collect_list(F.struct("cx", "_r", "value"))).alias("d"), (F.count(F.lit(1)) == 2).alias("both"), F.min("conf").alias("conf")
    )
    good = F.col("both") & (F.col("conf") >= least)
    return two.select("clip_id", "frame", F.when(good, F.get("d", F.lit(0)).value).alias("home"), F.when(good, F.get("d", F.lit(1)).value).alias("away"))


def landmark_spread(marks: DataFrame) -> DataFrame:
    """The largest distance between places of a tag seen in several keyframes. ``marks(clip_id, tag, keyframe, x, y)``."""
    a = marks.select("clip_id", "tag", "keyframe", "x", "y")
    b = marks.select("clip_id", "tag", F.col("keyframe").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    return a.join(b, ["clip_id", "tag"]).where("keyframe < k2").groupBy("clip_id", "tag").agg(F.max(F.sqrt(dx * dx + dy * dy)).alias("spread"))


def excluded_tracks(typed: DataFrame, spliced: DataFrame) -> DataFrame:
    """Tracks that carry no player: labelled ref, bench or spliced, or spliced by their reads; with each source."""
    human = typed.where(F.col("kind").isin("ref", "bench", "spliced")).select("clip_id", "track_id", F.col("kind").alias("source"))
    return human.unionByName(spliced.select("clip_id", "track_id", F.lit("auto_spliced").alias("source"))).distinct()


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every broken rule of every configuration row, in one pass. A rule is a condition that holds for bad rows."""
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in rules.items())))
    return rows.select("clip_id", F.explode(broken).alias("rule")).distinct()


def clip_diagnostics(diffs: DataFrame, cut: float, lost: float) -> DataFrame:
    """Suspected cuts, frames without lock and the largest difference. ``diffs(clip_id, frame, diff)``."""
    return diffs.groupBy("clip_id").agg(F.count_if(F.col("diff") >= cut).alias("cuts"), F.count_if(F.col("diff") >= lost).alias("lost"), F.count(F.lit(1)).alias("frames"), F.max("diff").alias("largest"))


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance between two position series at their common frames, by clip: mean and maximum."""
    other = b.select("clip_id", "frame", "track_id", F.col("court_x").alias("x2"), F.col("court_y").alias("y2"))
    dx, dy = F.col("court_x") - F.col("x2"), F.col("court_y") - F.col("y2")
    far = a.join(other, ["clip_id", "frame", "track_id"]).select("clip_id", F.sqrt(dx * dx + dy * dy).alias("d"))
    return far.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.max("d").alias("most"))


def extent(points: DataFrame) -> DataFrame:
    """Width and height of each frame's projected points."""
    return points.groupBy("clip_id", "frame").agg((F.max("court_x") - F.min("court_x")).alias("width"), (F.max("court_y") - F.min("court_y")).alias("height"))


def anchor_profile(anchors: DataFrame, inliers: int = 150, error: float = 2.0) -> DataFrame:
    """Inliers by clip and frames of low confidence. ``anchors(clip_id, frame, inliers, error)``."""
    ok = (F.col("inliers") >= inliers) & (F.col("error") <= error)
    return anchors.groupBy("clip_id").agg(F.min("inliers").alias("least"), F.percentile("inliers", F.lit(0.5)).alias("median"), F.max("inliers").alias("most"), F.count_if(~ok).alias("low_confidence"))


def outside_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points in no excluded rectangle of their clip; corners in any order, edges included."""
    r = regions.select(F.col("clip_id").alias("_c"), F.least("ax", "bx").alias("_x0"), F.greatest("ax", "bx").alias("_x1"), F.least("ay", "by").alias("_y0"), F.greatest("ay", "by").alias("_y1"))
    within = (F.col("clip_id") == F.col("_c")) & F.col("cx").between(F.col("_x0"), F.col("_x1")) & F.col("cy").between(F.col("_y0"), F.col("_y1"))
    return points.join(r, within, "left_anti")


def ledger(clips: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of each stage by clip; a clip passes if every stage has rows for it."""
    counts = [s.groupBy("clip_id").agg(F.count(F.lit(1)).alias(name)) for name, s in stages.items()]
    out = reduce(lambda a, b: a.join(b, "clip_id", "left"), counts, clips.select("clip_id").distinct()).fillna(0, list(stages))
    return out.withColumn("passed", F.least(*stages) > 0 if len(stages) > 1 else F.col(*stages) > 0)
