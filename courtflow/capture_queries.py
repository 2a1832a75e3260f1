"""Registered queries of camera motion, touches, courts, crops and bundles, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.operators import camera, courts, crops, identity, shots, team, touches
from courtflow.plans import box, stats
from courtflow.plans.tables import stored
from courtflow.queries import query
from courtflow.report_queries import _states

_FPS = 10.0


def _frames(t):
    return t.select("clip_id", "frame").distinct()


@query("st12_transforms", "tracks", sql="""SELECT clip_id, frame, CAST(sum(CASE WHEN ok AND i > 1 THEN frame % 7 - 3 ELSE 0 END) OVER w AS DOUBLE) AS dx, CAST(sum(CASE WHEN ok AND i > 1 THEN frame % 5 - 2 ELSE 0 END) OVER w AS DOUBLE) AS dy,
 NOT ok AND i > 1 AS held, count(*) FILTER (NOT ok AND i > 1) OVER w AS lost
 FROM (SELECT *, frame % 31 <> 0 AND frame % 29 <> 0 AS ok, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS i FROM (SELECT DISTINCT clip_id, frame FROM tracks)) WINDOW w AS (PARTITION BY clip_id ORDER BY frame)""")
def st12_transforms(t):
    """Pans, with steps that failed (null) or are out of scale; products in general are held against a plain loop in the tests."""
    f = F.col("frame")
    size = F.when(f % 31 == 0, 0.5).otherwise(1.0)
    g = F.array(size, F.lit(0.0), (f % 7 - 3).cast("double"), F.lit(0.0), size, (f % 5 - 2).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    steps = _frames(t).select("clip_id", "frame", F.when(f % 29 != 0, g).alias("g"))
    out = camera.cumulative_transforms(steps, block=60)
    return out.select("clip_id", "frame", F.get("a", F.lit(2)).alias("dx"), F.get("a", F.lit(5)).alias("dy"), "held", "lost")


@query("st13_stable_centres", "tracks", "ball", sql="""SELECT b.clip_id, b.frame, det_idx, cx + coalesce(dx, 0) AS cx, cy + coalesce(dy, 0) AS cy FROM ball b LEFT JOIN (
 SELECT clip_id, frame, sum(CASE WHEN i > 1 THEN frame % 7 - 3 ELSE 0 END) OVER w AS dx, sum(CASE WHEN i > 1 THEN frame % 5 - 2 ELSE 0 END) OVER w AS dy FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS i FROM (SELECT DISTINCT clip_id, frame FROM tracks)) WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) a
 ON a.clip_id = b.clip_id AND a.frame = b.frame""")
def st13_stable_centres(t, ball):
    f, one, none = F.col("frame"), F.lit(1.0), F.lit(0.0)
    steps = _frames(t).select("clip_id", "frame", F.array(one, none, (f % 7 - 3).cast("double"), none, one, (f % 5 - 2).cast("double"), none, none, one).alias("g"))
    return camera.stabilised(ball, camera.cumulative_transforms(steps, block=60)).select("clip_id", "frame", "det_idx", "cx", "cy")


@query("h7_carried_hoops", "tracks", sql="""SELECT f.clip_id, f.frame, h.hoop, CASE WHEN s = 'carried' THEN round(x, 6) END AS hx, CASE WHEN s = 'carried' THEN round(y, 6) END AS hy, CASE WHEN s <> 'no match' THEN kf END AS keyframe, s AS status FROM (
 SELECT *, CASE WHEN f.frame % 40 = 0 THEN 'no match' WHEN x BETWEEN -960 AND 2880 AND y BETWEEN -540 AND 1620 THEN 'carried' ELSE 'implausible' END AS s FROM (
  SELECT f.clip_id, f.frame, kf, hoop, (rx - kf * 2) / a - f.frame % 9 AS x, (ry - kf) / a - f.frame % 4 AS y FROM (SELECT *, CASE WHEN kf = 200 THEN 0.001E0 ELSE 1 + kf / 100.0E0 END AS a FROM (SELECT DISTINCT clip_id, frame, CAST(floor(frame / 50) * 50 AS BIGINT) AS kf FROM tracks)) f,
   (VALUES ('far', 1.5E0 * 850 + 100, 1.5E0 * 120 + 50), ('near', 2.0E0 * 300 + 200, 2.0E0 * 130 + 100)) h(hoop, rx, ry)) f) f, (VALUES ('far'), ('near')) h(hoop) WHERE h.hoop = f.hoop""")
def h7_carried_hoops(t):
    """Anchors clicked in keyframes 50 and 100; the last keyframe's transform shrinks so much that hoops land far off the picture."""
    kf = (F.floor(F.col("frame") / 50) * 50).alias("keyframe")
    none, one = F.lit(0.0), F.lit(1.0)
    matches = _frames(t).where("frame % 40 <> 0").select("clip_id", "frame", kf, F.array(one, none, (F.col("frame") % 9).cast("double"), none, one, (F.col("frame") % 4).cast("double"), none, none, one).alias("m"))
    k = F.col("keyframe")
    a = F.when(k == 200, 0.001).otherwise(1 + k / 100.0)
    keyframes = stored(t.select("clip_id").distinct().select("clip_id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(0, 250, 50)))).alias("keyframe")).select("clip_id", "keyframe", F.array(a, none, (k * 2).cast("double"), none, a, k.cast("double"), none, none, one).alias("k")))
    spots = F.array(*(F.struct(F.lit(h).alias("hoop"), F.lit(f).cast("long").alias("keyframe"), F.lit(x).alias("px"), F.lit(y).alias("py")) for h, f, x, y in (("far", 50, 850.0, 120.0), ("near", 100, 300.0, 130.0))))
    anchors = stored(t.select("clip_id").distinct().select("clip_id", F.explode(spots).alias("s")).select("clip_id", "s.*"))
    sizes = t.select("clip_id").distinct().select("clip_id", F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return camera.carried_hoops(t, matches, keyframes, anchors, sizes).withColumns({"hx": F.round("hx", 6), "hy": F.round("hy", 6)})


_HELD = """, seen AS (SELECT clip_id, frame, cx, cy + 180 AS cy FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame ORDER BY conf DESC, det_idx) AS r FROM ball WHERE conf >= 0.10) WHERE r = 1),
near AS (SELECT t.clip_id, t.frame, t.track_id, sqrt(greatest(x1 - cx, 0, cx - x2) * greatest(x1 - cx, 0, cx - x2) + greatest(y1 - cy, 0, cy - y2) * greatest(y1 - cy, 0, cy - y2)) / (y2 - y1) AS reach FROM tracks t JOIN seen ON seen.clip_id = t.clip_id AND seen.frame = t.frame WHERE y2 > y1 AND track_id NOT IN (3, 5)),
two AS (SELECT clip_id, frame, list(reach ORDER BY reach, track_id) AS d, list(track_id ORDER BY reach, track_id) AS who FROM near GROUP BY ALL),
verdicts AS (SELECT f.clip_id, f.frame, CASE WHEN seen.frame IS NULL THEN 'no_ball' WHEN d IS NULL OR d[1] > 0.3 THEN 'too_far' WHEN d[2] - d[1] < 0.15 THEN 'contested' ELSE 'held' END AS verdict, who[1] AS track_id, d[1] AS reach
 FROM (SELECT DISTINCT clip_id, frame FROM tracks) f LEFT JOIN seen ON seen.clip_id = f.clip_id AND seen.frame = f.frame LEFT JOIN two ON two.clip_id = f.clip_id AND two.frame = f.frame),
held AS (SELECT *, CASE WHEN lag(track_id) OVER w = track_id AND frame - lag(frame) OVER w - 1 <= 8 THEN 0 ELSE 1 END AS new FROM verdicts WHERE verdict = 'held' WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS s FROM held),
spans AS (SELECT clip_id, track_id, min(frame) AS a, max(frame) AS b, count(*) AS n FROM runs GROUP BY clip_id, s, track_id HAVING count(*) >= 6)"""


def _holders(t, ball):
    excluded = t.where("track_id in (3, 5)").select("clip_id", "track_id")
    return touches.frame_holders(_frames(t), t, ball.withColumn("cy", F.col("cy") + 180), excluded)


@query("st6_frame_holders", "tracks", "ball", sql=_HELD + " SELECT clip_id, frame, verdict, CASE WHEN verdict = 'held' THEN track_id END AS track_id, round(reach, 9) AS reach FROM verdicts")
def st6_frame_holders(t, ball):
    return _holders(t, ball).withColumn("reach", F.round("reach", 9))


@query("st6_touches", "tracks", "ball", sql=_HELD + """ SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY a) - 1 AS INT) AS touch, track_id, a AS start_frame, b AS end_frame, n AS held_frames, b - a + 1 AS span_frames,
 round_even(n / 10.0E0, 2) AS observed_seconds, round_even((b - a + 1 - n) / 10.0E0, 2) AS inferred_seconds, round_even((b - a + 1) / 10.0E0, 2) AS total_seconds FROM spans""")
def st6_touches(t, ball):
    return touches.touches(_holders(t, ball), _FPS)


@query("a35_touch_summary", "tracks", "ball", "oncourt", sql=_HELD + """,
z AS (SELECT s.*, CASE WHEN o.frame IS NULL THEN NULL WHEN d > 19.75 THEN 'three' WHEN d <= 8 THEN 'paint' ELSE 'midrange' END AS zone FROM spans s LEFT JOIN (SELECT *, least(sqrt((court_x-5.25)*(court_x-5.25)+(court_y-25)*(court_y-25)), sqrt((court_x-78.75)*(court_x-78.75)+(court_y-25)*(court_y-25))) AS d FROM oncourt) o
 ON o.clip_id = s.clip_id AND o.frame = s.a AND o.track_id = s.track_id)
SELECT clip_id, count(*) AS n_touches, count(*) FILTER (track_id % 2 = 0) AS n_nameable, round_even(sum(n) / 10.0E0, 1) AS observed_seconds, round_even(sum(b - a + 1 - n) / 10.0E0, 1) AS inferred_seconds,
 count(*) FILTER (zone = 'three') AS three, count(*) FILTER (zone = 'midrange') AS midrange, count(*) FILTER (zone = 'paint') AS paint FROM z GROUP BY ALL""")
def a35_touch_summary(t, ball, o):
    return touches.touch_summary(_attributed(t, ball, o)).drop("pct_inferred")


def _attributed(t, ball, o):
    holders = stored(_holders(t, ball))
    events = _states(t).withColumn("number", F.when(F.col("identity_id") % 2 == 0, F.col("identity_id")))
    return touches.attributed_touches(touches.touches(holders, _FPS), holders, events, o)


# four courts that look alike: two lengths, two lanes (fixed values of the marks' places)
COURTS = [("84 ft floor, 12 ft key", 84.0, 50.0, 19.0, 31.0, 19.0, 6.0), ("94 ft floor, 12 ft key", 94.0, 50.0, 19.0, 31.0, 19.0, 6.0), ("84 ft floor, 16 ft key", 84.0, 50.0, 17.0, 33.0, 19.0, 6.0), ("94 ft floor, 16 ft key", 94.0, 50.0, 17.0, 33.0, 19.0, 6.0)]


@query("a34_courts", "tracks")
def a34_courts(t):
    """Ten frames make a keyframe, whose tracks are marks of their clip's court (by clip) under a camera of its own, some px off."""
    table = courts.court_table(t.sparkSession, COURTS)
    order = F.row_number().over(courts.Window.partitionBy("court").orderBy("tag")) - 1
    tags = courts.court_tags(table).withColumn("track_id", order.cast("long"))
    true = F.get(F.array(*(F.lit(c[0]) for c in COURTS)), (F.col("clip_id") % 4).cast("int"))
    seen = t.groupBy("clip_id", F.floor(F.col("frame") / 10).alias("keyframe"), "track_id").agg(F.count(F.lit(1)).alias("n")).withColumn("court", true)
    met = seen.join(tags.hint("broadcast"), ["court", "track_id"])  # 21 marks of four courts
    depth = 1 + 0.004 * F.col("court_y") + 0.001 * (F.col("keyframe") % 5)
    off = (F.col("n") + F.col("keyframe")) % 3 - 1
    marks = met.select("clip_id", "keyframe", "tag", ((100 + 9 * F.col("court_x") + 2 * F.col("court_y")) / depth + off).alias("px"), ((700 - 8 * F.col("court_y")) / depth - off).alias("py"))
    return courts.identified_courts(courts.court_errors(stored(marks), table))


@query("w11_spaced_crops", "tracks")
def w11_spaced_crops(t):
    return crops.purity_crops(t)


@query("w12_review_crops", "tracks")
def w12_review_crops(t):
    return crops.review_crops(t, ["clip_id", "track_id"])


@query("w13_read_crops", "tracks")
def w13_read_crops(t):
    return crops.largest_spaced(t.withColumn("window", team.fixed_window()), ["clip_id", "window", "track_id"])


@query("i10_work_list", "tracks", "oncourt", "reads", sql="""SELECT a.clip_id, CAST(row_number() OVER (PARTITION BY a.clip_id ORDER BY round_even(coalesce(f, 0) / 10.0E0, 1) DESC, a.track_id) AS INT) AS rank, a.track_id, round_even(coalesce(f, 0) / 10.0E0, 1) AS floor_seconds, n_windows, s.track_id IS NOT NULL AS quarantined
 FROM (SELECT clip_id, track_id, count(DISTINCT floor(frame / 60)) AS n_windows FROM tracks GROUP BY ALL) a LEFT JOIN (SELECT clip_id, track_id, count(*) AS f FROM oncourt WHERE is_on GROUP BY ALL) o ON o.clip_id = a.clip_id AND o.track_id = a.track_id
 LEFT JOIN (SELECT clip_id, track_id FROM reads WHERE conf >= 0.85 GROUP BY ALL HAVING count(DISTINCT number) > 1) s ON s.clip_id = a.clip_id AND s.track_id = a.track_id""")
def i10_work_list(t, o, r):
    seeds = t.select("clip_id", team.fixed_window(), "track_id").distinct()
    out = crops.work_list(t, o, seeds, identity.purity(r).where("verdict = 'spliced'"), _FPS)
    return out.select("clip_id", "rank", "track_id", "floor_seconds", F.size("windows").cast("long").alias("n_windows"), "quarantined")


@query("w18_relink_audit", "tracks", "oncourt")
def w18_relink_audit(t, o):
    return box.relink_audit(t, box.possession_starts(o, _FPS))


@query("h8_measured_stats", "tracks", "oncourt", "reads", "labels_typed", "rosters", "shots", "ball")
def h8_measured_stats(t, o, r, labels, rosters, shot, ball):
    """The bundle of each clip as JSON, from the flagship's lines, located shots and touches."""
    run = box.identify(t, o, r, labels, rosters, _FPS)
    events = stored(box.credited(run))
    lines = identity.box_score(events, run.registry, o, _FPS, rosters=rosters)
    found = shots.locations(shot, o).join(shot.select(*shots.SHOT, "start_frame", "end_frame").hint("merge"), shots.SHOT).withColumn("shooter_status", F.lit("review_item"))
    attempts = shot.select("clip_id", "start_frame", "end_frame", "hoop", F.when(F.col("shot_id") % 4 == 0, "deflection").otherwise("shot_attempt").alias("verdict"), F.lit("jumpshot").alias("shot_type"))
    held = stored(_attributed(t, ball, o))
    out = stats.measured_stats(lines, identity.box_summary(events, run.registry, o, run.excluded, _FPS), found, attempts, touches=held, touch_summary=touches.touch_summary(held))
    return out.select("clip_id", F.to_json("doc", {"ignoreNullFields": "false"}).alias("doc"))
