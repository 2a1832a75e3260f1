"""Registered queries of ``operators.shots`` and ``operators.audit``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.functions import exprs as X
from courtflow.operators import audit, identity, shots, team
from courtflow.queries import query

_HOOPS = ", hoops AS (SELECT f.clip_id, f.frame, h.hoop, h.hx, h.hy FROM (SELECT DISTINCT clip_id, frame FROM tracks WHERE frame % 17 <> 0) f, (VALUES ('far', 850.0, 120.0), ('near', 300.0, 130.0)) h(hoop, hx, hy))"
_WINDOW = 'CAST(floor(frame / 60) AS BIGINT) AS "window"'


def _hoops(t):
    spots = F.array(*(F.struct(F.lit(n).alias("hoop"), F.lit(x).alias("hx"), F.lit(y).alias("hy")) for n, x, y in (("far", 850.0, 120.0), ("near", 300.0, 130.0))))
    return t.select("clip_id", "frame").distinct().where("frame % 17 != 0").select("clip_id", "frame", F.explode(spots).alias("s")).select("clip_id", "frame", "s.*")


def _identities(t):
    """Seven identities a window, each over two or three tracks."""
    return t.select("clip_id", team.fixed_window(), "frame", "track_id", F.col("track_pos").alias("event_ord"), (F.col("track_id") % 7).alias("identity_id"))


_IDS = f", ids AS (SELECT clip_id, {_WINDOW}, frame, track_id, track_pos, track_id % 7 AS identity_id FROM tracks)"


@query("j12_shooters", "shots", "tracks", sql="""SELECT s.clip_id, s.shot_id, s.track_id, CASE WHEN t.track_id IS NOT NULL THEN t.track_id + 100 END AS identity_id,
 CASE WHEN s.track_id IS NULL THEN 'no_confident_shooter' WHEN t.track_id IS NULL THEN 'no_identity_data' WHEN track_pos % 3 = 0 THEN 'attributed' ELSE 'review_item' END AS status
 FROM shots s LEFT JOIN tracks t ON s.clip_id = t.clip_id AND s.start_frame = t.frame AND s.track_id = t.track_id""")
def j12_shooters(s, t):
    state = F.when(F.col("track_pos") % 3 == 0, "confirmed").otherwise("candidate")
    return shots.shooters(s, t.select("clip_id", "frame", "track_id", F.col("track_pos").alias("event_ord"), (F.col("track_id") + 100).alias("identity_id"), state.alias("state")))


@query("j13_locations", "shots", "oncourt", sql="""SELECT clip_id, shot_id, coalesce(why, 'located') AS status, CASE WHEN why IS NULL THEN court_x END AS court_x, CASE WHEN why IS NULL THEN court_y END AS court_y FROM (
 SELECT s.clip_id, s.shot_id, court_x, court_y, CASE WHEN s.track_id IS NULL THEN 'no_release' WHEN f.frame IS NULL THEN 'frame_absent' WHEN o.frame IS NULL THEN 'track_absent' WHEN NOT is_on THEN 'off_court' END AS why
 FROM shots s LEFT JOIN (SELECT DISTINCT clip_id, frame FROM oncourt WHERE frame % 5 <> 0) f ON s.clip_id = f.clip_id AND s.start_frame = f.frame
 LEFT JOIN oncourt o ON o.frame % 5 <> 0 AND s.clip_id = o.clip_id AND s.start_frame = o.frame AND s.track_id = o.track_id)""")
def j13_locations(s, o):
    return shots.locations(s, o.where("frame % 5 != 0"))


@query("j14_made_nearby", "shots", "scores", sql="SELECT s.clip_id, s.shot_id, count(c.frame) AS changes, count(c.frame) > 0 AS made FROM shots s LEFT JOIN scores c ON s.clip_id = c.clip_id AND c.frame BETWEEN end_frame AND end_frame + 60 GROUP BY ALL")
def j14_made_nearby(s, c):
    return shots.made_nearby(s, c, 60)


@query("j15_first_change", "shots", "scores", sql="""SELECT w.clip_id, shot_id, window_end, min(c.frame) AS score_frame, count(c.frame) > 0 AS made FROM
 (SELECT *, least(end_frame + 180, coalesce(lead(start_frame) OVER (PARTITION BY clip_id ORDER BY start_frame, shot_id), end_frame + 180)) AS window_end FROM shots) w
 LEFT JOIN scores c ON w.clip_id = c.clip_id AND c.frame >= end_frame AND c.frame < window_end GROUP BY w.clip_id, shot_id, window_end""")
def j15_first_change(s, c):
    return shots.first_change(s, c)


@query("j16_reproduced", "shots", sql="SELECT v.clip_id, v.shot_id, count(c.clip_id) AS hits FROM shots v LEFT JOIN (SELECT clip_id, hoop, start_frame + 2 AS a, end_frame + 4 AS b FROM shots WHERE shot_id % 2 = 0) c ON v.clip_id = c.clip_id AND v.hoop = c.hoop AND abs(a - start_frame) <= 10 AND abs(b - end_frame) <= 10 GROUP BY ALL")
def j16_reproduced(s):
    claimed = s.where("shot_id % 2 = 0").select("clip_id", "hoop", (F.col("start_frame") + 2).alias("start_frame"), (F.col("end_frame") + 4).alias("end_frame"))
    return shots.reproduced(s, claimed)


@query("j17_unseen_frames", "shots", "ball", sql="SELECT DISTINCT clip_id, unnest(range(start_frame, end_frame + 1)) AS frame FROM shots EXCEPT SELECT clip_id, frame FROM ball WHERE conf >= 0.10")
def j17_unseen_frames(s, b):
    return shots.unseen_frames(s, b)


@query("w15_falls_below_rim", "shots", "ball", "tracks", sql=_HOOPS + """ SELECT clip_id, shot_id, count(*) AS points FROM (
 SELECT s.clip_id, s.shot_id, b.cy, lag(b.cy) OVER (PARTITION BY s.clip_id, s.shot_id ORDER BY b.frame, b.det_idx) AS p FROM shots s JOIN ball b ON s.clip_id = b.clip_id AND b.frame BETWEEN end_frame + 1 AND end_frame + 15
 JOIN hoops h ON h.clip_id = s.clip_id AND h.hoop = s.hoop AND h.frame = b.frame WHERE abs(b.cx - hx) <= 250 AND b.cy > hy) GROUP BY ALL HAVING count(*) >= 3 AND bool_and(p IS NULL OR cy >= p - 40)""")
def w15_falls_below_rim(s, b, t):
    return shots.falls_below_rim(s, b, _hoops(t), corridor=250.0, jitter=40.0)


@query("a26_shot_distribution", "positions", sql="""SELECT clip_id, n, three, midrange, paint, round_even(100.0*three/n, 1) AS pct_three, round_even(round_even(100.0*midrange/n, 1) + round_even(100.0*paint/n, 1), 1) AS pct_two FROM (
 SELECT clip_id, count(*) AS n, count(*) FILTER (d > 19.75) AS three, count(*) FILTER (d > 8 AND d <= 19.75) AS midrange, count(*) FILTER (d <= 8) AS paint FROM (
 SELECT clip_id, least(sqrt((court_x-5.25)*(court_x-5.25)+(court_y-25)*(court_y-25)), sqrt((court_x-78.75)*(court_x-78.75)+(court_y-25)*(court_y-25))) AS d FROM positions) GROUP BY clip_id)""")
def a26_shot_distribution(t):
    return shots.distribution(t.select("clip_id", X.shot_zone("court_x", "court_y")[0].alias("zone")))


@query("j8_near_hoop", "tracks", sql=_HOOPS + " SELECT clip_id, frame, track_id FROM tracks t WHERE EXISTS (SELECT 1 FROM hoops h WHERE h.clip_id = t.clip_id AND h.frame = t.frame AND ((x1+x2)/2-hx)*((x1+x2)/2-hx)+(y2-hy)*(y2-hy) <= 360.0*360.0)")
def j8_near_hoop(t):
    return shots.near_hoop(t, _hoops(t), 360.0).select("clip_id", "frame", "track_id")


@query("a24_readable_frames", "tracks", "oncourt", sql="SELECT t.clip_id, count(*) AS readable FROM tracks t JOIN oncourt o ON t.clip_id=o.clip_id AND t.frame=o.frame AND t.track_id=o.track_id AND is_on WHERE t.track_id <> 3 GROUP BY ALL")
def a24_readable_frames(t, o):
    return audit.readable_frames(t, o, t.where("track_id = 3").select("clip_id", "track_id").distinct())


@query("a28_correctness", "tracks", sql=_IDS + """ SELECT clip_id, count(*) FILTER (numbers > 0) AS judgeable, count(*) FILTER (numbers > 1) AS wrong, CAST(coalesce(sum(frames) FILTER (numbers > 1), 0) AS BIGINT) AS wrong_frames, count(*) FILTER (tracks > 1) AS can_fire FROM (
 SELECT clip_id, "window", identity_id, count(*) AS frames, count(DISTINCT track_id) AS tracks, count(DISTINCT CASE WHEN track_id % 4 <> 0 THEN track_id*7%50 END) AS numbers FROM ids GROUP BY ALL) GROUP BY clip_id""")
def a28_correctness(t):
    labels = t.where("track_id % 4 != 0").select("clip_id", "track_id", (F.col("track_id") * 7 % 50).alias("number")).distinct()
    return audit.correctness(_identities(t), labels)


@query("a30_crowded_frames", "tracks", sql="SELECT clip_id, frame, track_id % 2 AS team, count(DISTINCT track_id*7%50) AS players FROM tracks GROUP BY ALL HAVING count(DISTINCT track_id*7%50) > 5")
def a30_crowded_frames(t):
    return audit.crowded_frames(t.select("clip_id", "frame", (F.col("track_id") % 2).alias("team"), (F.col("track_id") * 7 % 50).alias("number")))


@query("j21_rekeyed", "tracks", sql=_IDS + """ SELECT r.clip_id, r."window", r.identity_id, coalesce(n, 0) AS tracks, CASE WHEN n = 1 THEN tid END AS track_id, CASE WHEN n = 1 THEN 'migrated' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status FROM
 (SELECT DISTINCT clip_id, "window", track_id AS identity_id FROM ids WHERE track_id < 10) r LEFT JOIN (SELECT clip_id, "window", identity_id, count(DISTINCT track_id) AS n, min(track_id) AS tid FROM ids GROUP BY ALL) c ON c.clip_id=r.clip_id AND c."window"=r."window" AND c.identity_id=r.identity_id""")
def j21_rekeyed(t):
    ids = _identities(t)
    return audit.rekeyed(ids.where("track_id < 10").select("clip_id", "window", F.col("track_id").alias("identity_id")).distinct(), ids)


@query("j20_resolved", "tracks", sql=_IDS + """ SELECT r.clip_id, r."window", r.track_id, l.identity_id, CASE WHEN l.identity_id IS NULL THEN 'refused' ELSE 'resolved' END AS status FROM
 (SELECT DISTINCT clip_id, "window", track_id + 5 AS track_id FROM ids) r LEFT JOIN (SELECT clip_id, "window", track_id, arg_max(identity_id, track_pos) AS identity_id FROM ids GROUP BY ALL) l ON l.clip_id=r.clip_id AND l."window"=r."window" AND l.track_id=r.track_id""")
def j20_resolved(t):
    ids = _identities(t)
    return audit.resolved(ids.select("clip_id", "window", (F.col("track_id") + 5).alias("track_id")).distinct(), ids)


@query("w6_seed_tracks", "oncourt", sql=f""", w AS (SELECT *, {_WINDOW} FROM oncourt), v AS (SELECT clip_id, "window", track_id FROM w GROUP BY ALL HAVING count(*) FILTER (is_on) > count(*) FILTER (NOT is_on))
 SELECT DISTINCT f.clip_id, f."window", f.track_id FROM (SELECT *, min(frame) OVER (PARTITION BY clip_id, "window") AS a FROM w) f JOIN v ON v.clip_id=f.clip_id AND v."window"=f."window" AND v.track_id=f.track_id WHERE f.frame = f.a""")
def w6_seed_tracks(o):
    placed = o.withColumn("window", team.fixed_window())
    return audit.seed_tracks(placed, identity.on_court_vote(placed))


@query("w10_scoreboard", "tracks", sql="""SELECT clip_id, frame, CASE WHEN n = 2 AND c >= 0.15 THEN d[1].value END AS home, CASE WHEN n = 2 AND c >= 0.15 THEN d[2].value END AS away FROM (
 SELECT clip_id, frame, count(*) AS n, min(conf) AS c, list({'cx': cx, 'r': r, 'value': track_id} ORDER BY cx, r) AS d FROM (SELECT *, (x1+x2)/2 AS cx, (track_pos%100)/100.0E0 AS conf, row_number() OVER (PARTITION BY clip_id, frame ORDER BY y2-y1 DESC, track_pos) AS r FROM tracks) WHERE r <= 2 GROUP BY ALL)""")
def w10_scoreboard(t):
    return audit.scoreboard(t.select("clip_id", "frame", F.col("track_pos").alias("det_idx"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), (F.col("y2") - F.col("y1")).alias("h"), F.col("track_id").alias("value"), (F.col("track_pos") % 100 / 100).alias("conf")))


@query("j24_landmark_spread", "tracks", sql="SELECT a.clip_id, a.track_id AS tag, round(max(sqrt((a.x1-b.x1)*(a.x1-b.x1)+(a.y2-b.y2)*(a.y2-b.y2))), 6) AS spread FROM tracks a JOIN tracks b ON a.clip_id=b.clip_id AND a.track_id=b.track_id AND a.frame<b.frame WHERE a.frame%50=0 AND b.frame%50=0 GROUP BY ALL")
def j24_landmark_spread(t):
    marks = t.where("frame % 50 = 0").select("clip_id", F.col("track_id").alias("tag"), F.col("frame").alias("keyframe"), F.col("x1").alias("x"), F.col("y2").alias("y"))
    return audit.landmark_spread(marks).withColumn("spread", F.round("spread", 6))


@query("u1_excluded_tracks", "tracks", "reads", sql="""SELECT DISTINCT clip_id, track_id, CASE track_id WHEN 3 THEN 'ref' WHEN 5 THEN 'bench' ELSE 'spliced' END AS source FROM tracks WHERE track_id IN (3, 5, 8)
 UNION SELECT clip_id, track_id, 'auto_spliced' FROM reads WHERE conf >= 0.85 GROUP BY ALL HAVING count(DISTINCT number) > 1""")
def u1_excluded_tracks(t, r):
    tid = F.col("track_id")
    typed = t.select("clip_id", "track_id", F.when(tid == 3, "ref").when(tid == 5, "bench").when(tid == 8, "spliced").otherwise("number").alias("kind"))
    return audit.excluded_tracks(typed, identity.purity(r).where("verdict = 'spliced'"))


@query("s22_violations", "shots", sql="SELECT DISTINCT clip_id, 'no_release' AS rule FROM shots WHERE track_id IS NULL UNION SELECT clip_id, 'long_span' FROM shots WHERE end_frame - start_frame > 14 UNION SELECT clip_id, 'off_roster' FROM shots WHERE track_id*7%50 > 40")
def s22_violations(s):
    return audit.violations(s, {"no_release": F.col("track_id").isNull(), "long_span": F.col("end_frame") - F.col("start_frame") > 14, "off_roster": F.col("track_id") * 7 % 50 > 40})


@query("a41_drift", "oncourt", sql="SELECT clip_id, count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS most FROM (SELECT clip_id, sqrt((track_id/10.0E0)*(track_id/10.0E0) + 0.25) AS d FROM oncourt WHERE frame % 30 = 0) GROUP BY ALL")
def a41_drift(o):
    moved = o.where("frame % 30 = 0").select("clip_id", "frame", "track_id", (F.col("court_x") + F.col("track_id") / 10).alias("court_x"), (F.col("court_y") - 0.5).alias("court_y"))
    return audit.drift(o, moved).select("clip_id", "n", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


@query("a39_extent", "oncourt", sql="SELECT clip_id, frame, round(max(court_x) - min(court_x), 6) AS width, round(max(court_y) - min(court_y), 6) AS height FROM oncourt GROUP BY ALL")
def a39_extent(o):
    return audit.extent(o).select("clip_id", "frame", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


@query("a36_anchor_profile", "tracks", sql="SELECT clip_id, min(i) AS least, median(i) AS median, max(i) AS most, count(*) FILTER (NOT (i >= 150 AND e <= 2.0)) AS low_confidence FROM (SELECT clip_id, frame, count(*) * 20 AS i, (frame % 50) / 20.0E0 AS e FROM tracks GROUP BY clip_id, frame) GROUP BY ALL")
def a36_anchor_profile(t):
    return audit.anchor_profile(t.groupBy("clip_id", "frame").agg((F.count(F.lit(1)) * 20).alias("inliers"), (F.col("frame") % 50 / 20).alias("error")))


@query("p14_outside_regions", "ball", sql="SELECT clip_id, frame, det_idx FROM ball WHERE NOT (cx BETWEEN 400 AND 700 AND cy BETWEEN 150 AND 220)")
def p14_outside_regions(b):
    regions = b.select("clip_id").distinct().select("clip_id", F.lit(700.0).alias("ax"), F.lit(150.0).alias("ay"), F.lit(400.0).alias("bx"), F.lit(220.0).alias("by"))
    return audit.outside_regions(b, regions).select("clip_id", "frame", "det_idx")


@query("s18_ledger", "tracks", "ball", "shots", sql="SELECT c.clip_id, coalesce(b, 0) AS ball, coalesce(s, 0) AS shots, coalesce(b, 0) > 0 AND coalesce(s, 0) > 0 AS passed FROM (SELECT DISTINCT clip_id FROM tracks) c LEFT JOIN (SELECT clip_id, count(*) AS b FROM ball WHERE clip_id % 3 <> 1 GROUP BY ALL) x USING (clip_id) LEFT JOIN (SELECT clip_id, count(*) AS s FROM shots GROUP BY ALL) y USING (clip_id)")
def s18_ledger(t, b, s):
    return audit.ledger(t, {"ball": b.where("clip_id % 3 != 1"), "shots": s})


@query("j18_overlaps", "tracks", sql=_IDS + """ SELECT a.clip_id, a."window", a.identity_id, a.number, count(*) AS frames FROM (SELECT DISTINCT clip_id, "window", identity_id, identity_id AS number, frame FROM ids WHERE track_id < 7) a
 JOIN (SELECT DISTINCT clip_id, "window", identity_id AS number, frame FROM ids WHERE track_id >= 7) b ON a.clip_id=b.clip_id AND a."window"=b."window" AND a.number=b.number AND a.frame=b.frame GROUP BY ALL""")
def j18_overlaps(t):
    rows = _identities(t).withColumn("number", F.col("identity_id"))
    return audit.overlaps(rows.where("track_id < 7"), rows.where("track_id >= 7")).drop("first_frames")
