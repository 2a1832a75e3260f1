"""Small reports, orders, guards and reuse rules; every one keeps ``clip_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions import exprs as X

#: Frame margin of feet, share of a frame beyond which a point is implausible, court margin in feet.
EDGE_PX, BEYOND, ROI_MARGIN = 4.0, 0.5, 1.5
#: Fixed values of the shot-outcome evidence: frames, pixels near the hoop, pixels away from it.
WATCH, NEAR_PX, ESCAPE_PX = 15, 100.0, 60.0


def drop_counts(positions: DataFrame) -> DataFrame:
    """Bodies off court and bodies without a transform, by clip."""
    return positions.groupBy("clip_id").agg(F.count_if(F.col("court_x").isNotNull() & ~F.col("is_on")).alias("off_court"), F.count_if(F.col("court_x").isNull()).alias("motion_lost"), F.count(F.lit(1)).alias("bodies"))


def pace(possessions: DataFrame, frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """A10: possessions a minute over each clip's frames; 0 where they span no time."""
    n = possessions.groupBy("clip_id").agg(F.count(F.lit(1)).alias("possessions"))
    span = frames.groupBy("clip_id").agg(((F.max("frame") - F.min("frame")) / fps / 60).alias("minutes"))
    out = span.join(n, "clip_id", "left").withColumn("possessions", F.coalesce("possessions", F.lit(0).cast("long")))
    return out.withColumn("pace", F.coalesce(F.try_divide("possessions", "minutes"), F.lit(0.0)))


def mean_colors(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The mean colour of each track (or other ``keys``)."""
    return samples.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("c0", "c1", "c2")), F.count(F.lit(1)).alias("samples"))


def located_counts(locations: DataFrame) -> DataFrame:
    """Shots with and without a place; the latter are counted, never charted."""
    return locations.groupBy("clip_id").agg(F.count_if(F.col("status") == "located").alias("located"), F.count_if(F.col("status") != "located").alias("unlocated"))


def use_shares(frames: DataFrame) -> DataFrame:
    """Shares (percent, one decimal) of readable frames that are credited, and of labelled ones; null without any.

    ``frames(clip_id, readable, labelled, credited)``, a row a body and frame.
    """
    pct = lambda a, b: F.bround(F.try_divide(100 * F.count_if(a), F.count_if(b)), 1)
    credited, readable, labelled = F.col("credited"), F.col("readable"), F.col("labelled")
    return frames.groupBy("clip_id").agg(pct(credited & readable, readable).alias("pct_of_readable"), pct(credited & labelled, labelled).alias("pct_of_labelled"))


def compared(before: DataFrame, after: DataFrame, slack: float = 0.05) -> DataFrame:
    """Two reports ``(clip_id, wrong_seconds, check_can_fire)``: REGRESSION where more time is wrong, UNMEASURED where the check
    can no longer fire, else ok."""
    old = before.select("clip_id", F.col("wrong_seconds").alias("before"))
    both = old.join(after.select("clip_id", F.col("wrong_seconds").alias("after"), "check_can_fire"), "clip_id")
    more = F.col("after") - F.col("before")
    trend = F.when(more > slack, "worse").when(more < -slack, "better").otherwise("same")
    verdict = F.when(more > slack, "REGRESSION").when(~F.col("check_can_fire"), "UNMEASURED").otherwise("ok")
    return both.select("clip_id", "before", "after", trend.alias("trend"), verdict.alias("verdict"))


def queue_summary(items: DataFrame) -> DataFrame:
    """Queue items on court and those left out, every exclusion counted. ``items(clip_id, on_court, excluded)``."""
    inside = F.coalesce(F.col("on_court"), F.lit(False))
    return items.groupBy("clip_id").agg(
        F.count_if(inside & F.col("excluded").isNull()).alias("queued"), F.count_if(~inside).alias("off_court"), F.count_if(inside & F.col("excluded").isNotNull()).alias("excluded")
    )


def keyframe_plan(keyframes: DataFrame, matches: DataFrame, weak: float = 0.5) -> DataFrame:
    """Neighbouring keyframes with their gap and inlier ratio; ``weak`` is a parameter. ``matches(clip_id, a, b, ratio)``."""
    w = Window.partitionBy("clip_id").orderBy("keyframe")
    pairs = keyframes.select("clip_id", F.col("keyframe").alias("a"), F.lead("keyframe").over(w).alias("b")).where("b is not null")
    out = pairs.join(matches, ["clip_id", "a", "b"], "left")
    return out.select("clip_id", "a", "b", (F.col("b") - F.col("a")).alias("gap"), "ratio", F.coalesce(F.col("ratio") < weak, F.lit(True)).alias("weak"))


def ranked(rows: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """A number from 1 in an order within ``keys``; tables have no order of their own."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Box lines by seconds, most first; ties by number and team."""
    return ranked(lines, ["clip_id"], F.desc("seconds_total"), F.col("number"), F.col("team"))


def queue_order(items: DataFrame) -> DataFrame:
    """By window, frame and track, nulls as 0."""
    return ranked(items, ["clip_id"], F.col("window"), F.coalesce("frame", F.lit(0)), F.coalesce("track_id", F.lit(0)))


def first_frames(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the frames under ``n`` of each clip."""
    return rows.where(F.col("frame") < n)


def missing_frames(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """U4: frames that are wanted and not there."""
    return wanted.select("clip_id", "frame").distinct().join(there.select("clip_id", "frame"), ["clip_id", "frame"], "left_anti")


def united_frames(spans: DataFrame, picks: DataFrame) -> DataFrame:
    """Frames of known spans and picked ones, once each."""
    known = spans.select("clip_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return known.union(picks.select("clip_id", "frame")).distinct()


def trusted_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with a good transform, and the skipped ones with a reason. ``frames(clip_id, frame, state)``."""
    skipped = frames.where(~F.coalesce(F.col("state") == "ok", F.lit(False)))
    return frames.where("state = 'ok'"), skipped.withColumn("reason", F.coalesce("state", F.lit("no transform")))


def above_floor(dets: DataFrame, conf: float = 0.10) -> DataFrame:
    """Frames keep a row, with null detections where none reaches ``conf``."""
    spine = dets.select("clip_id", "frame").distinct()
    return spine.join(dets.where(F.col("conf") >= conf), ["clip_id", "frame"], "left")


def resolved_labels(tracks: DataFrame, config: DataFrame, human: DataFrame) -> DataFrame:
    """P20: a person's label over the configured one, by presence even where it is null; spliced refuses.

    ``config`` and ``human`` hold (clip_id, track_id, label), one row a track.
    """
    key = ["clip_id", "track_id"]
    out = tracks.select(*key).distinct().join(config.select(*key, F.col("label").alias("_c")), key, "left").join(human.select(*key, F.col("label").alias("_h"), F.lit(True).alias("_by")), key, "left")
    label = F.when(F.col("_by"), F.col("_h")).otherwise(F.col("_c"))
    reason = F.when(label.isNull(), "unlabeled").when(label == "spliced", "refused_spliced").otherwise("labeled")
    return out.select(*key, F.when(reason == "labeled", label).alias("label"), reason.alias("reason"), F.coalesce("_by", F.lit(False)).alias("by_person"))


def with_teams(tracks: DataFrame, teams: DataFrame) -> DataFrame:
    """Tracks with a team; the others go."""
    return tracks.join(teams.select("clip_id", "track_id", "team"), ["clip_id", "track_id"])


def overlapping_tracks(tracks: DataFrame, boxes: DataFrame, least: float = 0.5, conf: float = 0.4) -> DataFrame:
    """Tracks that a box of the same frame overlaps by ``least`` (IoU); ``boxes(clip_id, frame, bx1, by1, bx2, by2, conf)``."""
    met = tracks.join(boxes.where(F.col("conf") >= conf).hint("merge"), ["clip_id", "frame"])
    return met.where(X.iou(["x1", "y1", "x2", "y2"], ["bx1", "by1", "bx2", "by2"]) >= least).select("clip_id", "track_id").distinct()


def nearest_feet(spots: DataFrame, tracks: DataFrame) -> DataFrame:
    """The track whose feet are nearest to each spot ``(clip_id, frame, px, py)`` in its frame; ties to the lower track."""
    fx, fy = X.feet_point("x1", "y1", "x2", "y2")
    met = spots.join(tracks.select("clip_id", "frame", "track_id", fx.alias("fx"), fy.alias("fy")).hint("merge"), ["clip_id", "frame"])
    d = F.sqrt((F.col("fx") - F.col("px")) * (F.col("fx") - F.col("px")) + (F.col("fy") - F.col("py")) * (F.col("fy") - F.col("py")))
    return met.groupBy("clip_id", "frame", "px", "py").agg(F.min(F.struct(d.alias("d"), "track_id")).alias("b")).select("clip_id", "frame", "px", "py", "b.track_id", F.col("b.d").alias("dist"))


def located_attempts(attempts: DataFrame, locations: DataFrame) -> DataFrame:
    """Attempts with the location of the same start and end, if any."""
    return attempts.join(locations, ["clip_id", "start_frame", "end_frame"], "left")


def queue_identities(items: DataFrame, registry: DataFrame, states: tuple[str, ...] = ("candidate", "unknown")) -> DataFrame:
    """Queue items with their identity of a final state in ``states``; of several items of one the first (by frame, track)."""
    met = items.join(registry.where(F.col("final_state").isin(*states)), ["clip_id", "window", "track_id"])
    return ranked(met, ["clip_id", "window", "identity_id"], F.col("frame"), F.col("track_id")).where("rank = 1").drop("rank")


def keyframe_gaps(pairs: DataFrame, transforms: DataFrame) -> DataFrame:
    """Mean and largest distance between two keyframes' projections of the same points.

    ``pairs(clip_id, a, b, px, py, qx, qy)``: a mark's pixel in keyframes a and b; ``transforms(clip_id, keyframe, h0..h8)``.
    """
    h = [f"h{i}" for i in range(9)]
    of = lambda k: transforms.select("clip_id", F.col("keyframe").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in h)).hint("merge")
    met = pairs.join(of("a"), ["clip_id", "a"]).join(of("b"), ["clip_id", "b"])
    x, y, _ = X.project([f"a_{c}" for c in h], F.col("px"), F.col("py"))
    u, v, _ = X.project([f"b_{c}" for c in h], F.col("qx"), F.col("qy"))
    gap = F.sqrt((x - u) * (x - u) + (y - v) * (y - v))
    return met.groupBy("clip_id", "a", "b").agg(F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.count(gap).alias("marks"))


def deflections(shots: DataFrame, points: DataFrame, hoops: DataFrame, watch: int = WATCH, near: float = NEAR_PX, escape: float = ESCAPE_PX) -> DataFrame:
    """H5: for each shot the first chain that is near its hoop within ``watch`` frames after it and ends away from it.

    ``shots(clip_id, shot_id, hoop, end_frame)``, ``points(clip_id, chain, frame, cx, cy)`` with one row a chain and frame,
    ``hoops(clip_id, frame, hoop, hx, hy)``. Without a hoop at the chain's last frame, its way from the first point counts.
    """
    size = 64
    spans = shots.withColumn("block", F.explode(F.sequence(F.floor((F.col("end_frame") + 1) / size), F.floor((F.col("end_frame") + watch) / size))))
    seen = points.select("clip_id", "chain", "frame", "cx", "cy", F.floor(F.col("frame") / size).alias("block"))
    met = spans.hint("merge").join(seen, ["clip_id", "block"]).where((F.col("frame") > F.col("end_frame")) & (F.col("frame") <= F.col("end_frame") + watch))
    start = met.groupBy("clip_id", "shot_id", "hoop", "chain").agg(F.min(F.struct("frame", "cx", "cy")).alias("s")).select("clip_id", "shot_id", "hoop", "chain", F.col("s.frame").alias("frame"), F.col("s.cx").alias("sx"), F.col("s.cy").alias("sy"))
    far = lambda x, y, u, v: F.sqrt((F.col(x) - F.col(u)) * (F.col(x) - F.col(u)) + (F.col(y) - F.col(v)) * (F.col(y) - F.col(v)))
    start = start.join(hoops.hint("merge"), ["clip_id", "frame", "hoop"]).withColumn("start_dist", far("sx", "sy", "hx", "hy")).where(F.col("start_dist") <= near).drop("hx", "hy")
    ends = points.groupBy("clip_id", "chain").agg(F.max(F.struct("frame", "cx", "cy")).alias("e")).select("clip_id", "chain", F.col("e.frame").alias("end_at"), F.col("e.cx").alias("ex"), F.col("e.cy").alias("ey"))
    last = start.join(ends.hint("merge"), ["clip_id", "chain"]).where("end_at > frame")
    there = hoops.select("clip_id", F.col("frame").alias("end_at"), "hoop", "hx", "hy").hint("merge")
    gone = last.join(there, ["clip_id", "end_at", "hoop"], "left").withColumn("end_dist", F.coalesce(far("ex", "ey", "hx", "hy"), far("ex", "ey", "sx", "sy"))).where(F.col("end_dist") >= escape)
    first = gone.groupBy("clip_id", "shot_id").agg(F.min(F.struct("chain", "frame", "start_dist", "end_at", "end_dist")).alias("d"))
    return first.select("clip_id", "shot_id", "d.chain", F.col("d.frame").alias("start_frame"), F.bround("d.start_dist", 1).alias("start_dist"), F.col("d.end_at").alias("end_frame"), F.bround("d.end_dist", 1).alias("end_dist"))


def outcomes(shots: DataFrame, falls: DataFrame, deflected: DataFrame) -> DataFrame:
    """H6: candidate_make, candidate_miss or unknown (with ``conflict`` where both speak); never a bare statistic."""
    key = ["clip_id", "shot_id"]
    out = shots.select(*key).join(falls.select(*key, F.lit(True).alias("fell")).distinct(), key, "left").join(deflected.select(*key, F.lit(True).alias("left_rim")).distinct(), key, "left")
    fell, rim = F.coalesce("fell", F.lit(False)), F.coalesce("left_rim", F.lit(False))
    outcome = F.when(fell & ~rim, "candidate_make").when(rim & ~fell, "candidate_miss").otherwise("unknown")
    return out.select(*key, outcome.alias("outcome"), F.when(fell & rim, "conflict").when(~fell & ~rim, "no evidence").alias("reason"))


def unconfirmed_claims(events: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Confirmed identities without a confirmation by seed or second signal; must be empty."""
    key = ["clip_id", "window", "identity_id"]
    good = confirmations.where(F.col("provenance").isin("seed", "second_signal")).select(*key)
    return events.where("state = 'confirmed'").select(*key).distinct().join(good, key, "left_anti")


def read_candidates(registry: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I4: identities to read numbers for (ever unresolved, not confirmed, on court), and the off-court ones by clip, counted."""
    open_ = registry.where("ever_unresolved and final_state != 'confirmed'")
    key = ["clip_id", "window", "track_id"]
    on = votes.where("on_court").select(*key)
    return open_.join(on, key, "left_semi"), open_.join(on, key, "left_anti").groupBy("clip_id").agg(F.count(F.lit(1)).alias("off_court"))


def review_queue(items: DataFrame) -> DataFrame:
    """``items(clip_id, window, identity_id, track_id, state, relink_frame, recent)`` with the frame to look at and a reason.

    A candidate is shown where it was relinked, others at the first of their ``recent`` frames.
    """
    frame = F.coalesce(F.when(F.col("state") == "candidate", F.col("relink_frame")), F.array_min("recent"))
    why = F.when(F.col("state") == "candidate", F.format_string("relinked at frame %d, never above candidate", F.col("relink_frame"))).otherwise("no confirmed identity")
    return queue_order(items.select("clip_id", "window", "identity_id", "track_id", "state", frame.alias("frame"), why.alias("why")))


def presence(events: DataFrame, fps: float = 30.0) -> DataFrame:
    """I8: confirmed frames and seconds of each identity, and the frames that need review; uncertainty is never counted."""
    sure = F.col("state") == "confirmed"
    return events.groupBy("clip_id", "window", "identity_id").agg(F.count_if(sure).alias("confirmed_frames"), (F.count_if(sure) / fps).alias("seconds"), F.count_if(~sure).alias("review_frames"))


def cross_checked(labels: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions whose track carries another label already; flagged, never picked."""
    other = labels.select("clip_id", "track_id", F.col("number").alias("labelled"))
    return resolutions.join(other, ["clip_id", "track_id"]).where(F.col("number") != F.col("labelled"))


def stale_artifacts(stored: DataFrame, config: DataFrame, fields: list[str]) -> DataFrame:
    """Clips whose stored fingerprint differs from the configuration in any of ``fields`` (nulls are values), or is absent."""
    other = stored.select("clip_id", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_there"))
    met = config.select("clip_id", *fields).join(other, "clip_id", "left")
    wrong = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    why = F.when(F.col("_there").isNull(), F.lit("absent")).otherwise(F.array_join(wrong, ","))
    return met.select("clip_id", why.alias("differs")).where("differs != ''")


def covering_artifacts(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (clip_id, start, end, anchors) whether a stored span with the same anchors covers it."""
    other = stored.select("clip_id", "anchors", F.col("start").alias("s"), F.col("end").alias("e"))
    met = wanted.join(other, ["clip_id", "anchors"], "left")
    return met.groupBy("clip_id", "start", "end", "anchors").agg(F.coalesce(F.bool_or((F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end"))), F.lit(False)).alias("reusable"))


def positions_only(events: DataFrame) -> DataFrame:
    """The view without identities."""
    return events.select(*(c for c in events.columns if c not in ("identity_id", "identity_state", "state", "team", "number", "track_id")))


def on_floor(x: Column, y: Column, w: Column, reference: float, length: float = 84.0, width: float = 50.0) -> Column:
    """On the right side of the horizon (depth of the sign of ``reference``) and within the court's margin."""
    return (w * reference > 0) & X.in_court(x, y, length, width, ROI_MARGIN)


def feet_on_screen(fy: Column, height: float) -> Column:
    """Feet at the lower edge of the frame are cut off and not trusted."""
    return fy < height - EDGE_PX


def plausible(x: Column, y: Column, width: float, height: float) -> Column:
    """P10: within the frame, widened by half of it on each side."""
    return x.between(-BEYOND * width, (1 + BEYOND) * width) & y.between(-BEYOND * height, (1 + BEYOND) * height)


def sign_fixed(m: list[Column], cx: float, cy: float) -> list[Column]:
    """The transform, negated if the frame's centre has negative depth."""
    depth = m[6] * cx + m[7] * cy + m[8]
    return [F.when(depth < 0, -x).otherwise(x) for x in m]


def is_ambiguous(team: Column) -> Column:
    """A line that belongs to one of several teams."""
    return team.startswith("AMBIGUOUS")
