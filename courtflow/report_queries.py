"""Registered queries of ``operators.reports``, ``operators.merge`` and the column helpers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.functions import exprs as X
from courtflow.operators import identity, merge, reports, shots, team
from courtflow.plans.tables import stored
from courtflow.queries import _BX, _ZONE, query
from courtflow.shot_queries import _HOOPS, _hoops

_W = 'CAST(floor(frame / 60) AS BIGINT) AS "window"'
_STATES = f""", ev AS (SELECT clip_id, {_W}, frame, track_id, track_id AS identity_id, CASE track_pos % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'confirmed_retroactive' ELSE 'candidate' END AS state FROM tracks)"""


def _states(t):
    """One identity a track; states by the place in the document."""
    k = F.col("track_pos") % 3
    state = F.when(k == 0, "confirmed").when(k == 1, "confirmed_retroactive").otherwise("candidate")
    return t.select("clip_id", team.fixed_window(), "frame", "track_id", F.col("track_id").alias("identity_id"), state.alias("state"))


@query("a23_box_lines", "tracks", "oncourt", sql=_STATES + f""",
c AS (SELECT *, identity_id % 5 AS number FROM ev WHERE state <> 'candidate'),
g AS (SELECT clip_id, number, frame, count(DISTINCT ("window", identity_id)) > 1 AS disputed, min(identity_id) AS identity_id, arg_min(state, identity_id) AS state, min("window") AS "window" FROM c GROUP BY ALL),
l AS (SELECT *, CASE WHEN number = 4 THEN 'off-roster?' WHEN number = 3 THEN CASE WHEN NOT disputed AND identity_id = 3 THEN 'team_a' ELSE 'AMBIGUOUS (team_a / team_b)' END WHEN number % 2 = 0 THEN 'team_a' ELSE 'team_b' END AS team FROM g),
p AS (SELECT l.*, CASE WHEN o.frame IS NOT NULL THEN {_ZONE} END AS zone FROM l LEFT JOIN (SELECT *, {_BX} AS bx FROM oncourt) o ON l.clip_id = o.clip_id AND l.frame = o.frame AND l.identity_id = o.track_id),
z AS (SELECT clip_id, number, team, zone, count(*) FILTER (NOT disputed) AS n, min(frame) FILTER (NOT disputed) AS a FROM p WHERE zone IS NOT NULL GROUP BY ALL),
t AS (SELECT clip_id, number, team, list(zone ORDER BY n DESC, a)[1] AS top_zone FROM z WHERE n > 0 GROUP BY ALL)
SELECT p.clip_id, p.number, p.team, count(*) FILTER (NOT disputed AND state = 'confirmed') AS live, count(*) FILTER (NOT disputed AND state <> 'confirmed') AS retro, count(*) FILTER (disputed) AS disputed_frames,
 count(DISTINCT CASE WHEN NOT disputed THEN "window" END) AS windows_present, count(*) FILTER (NOT disputed AND zone IS NULL) AS unpositioned_frames, any_value(top_zone) AS top_zone
FROM p LEFT JOIN t ON p.clip_id = t.clip_id AND p.number = t.number AND p.team = t.team GROUP BY p.clip_id, p.number, p.team HAVING count(*) FILTER (NOT disputed) > 0 OR p.number = 3""")
def a23_box_lines(t, o):
    events = _states(t)
    numbers = events.select("clip_id", "window", "identity_id", (F.col("identity_id") % 5).alias("number")).distinct()
    roster = F.inline(F.array(*(F.struct(F.lit(f"team_{x}").alias("team"), F.lit(n).cast("long").alias("number")) for x, n in (("a", 0), ("b", 1), ("a", 2), ("a", 3), ("b", 3)))))
    rosters = t.select("clip_id").distinct().select("clip_id", roster)
    teams = numbers.where("identity_id = 3").select("clip_id", "window", "identity_id", F.lit("team_a").alias("team"))
    out = identity.box_score(events, numbers, o, 1.0, rosters=rosters, identity_teams=teams)
    return out.select("clip_id", "number", "team", F.col("seconds_live").cast("long").alias("live"), F.col("seconds_retro").cast("long").alias("retro"), "disputed_frames", F.col("windows_present").cast("long").alias("windows_present"), "unpositioned_frames", "top_zone")


@query("a9_drop_counts", "oncourt", sql="SELECT clip_id, count(*) FILTER (court_x IS NOT NULL AND NOT is_on) AS off_court, count(*) FILTER (court_x IS NULL) AS motion_lost, count(*) AS bodies FROM (SELECT clip_id, is_on, CASE WHEN frame % 40 <> 0 THEN court_x END AS court_x FROM oncourt) GROUP BY ALL")
def a9_drop_counts(t):
    return reports.drop_counts(t.withColumn("court_x", F.when(F.col("frame") % 40 != 0, F.col("court_x"))))


@query("a10_pace", "oncourt", sql="SELECT clip_id, round((max(frame) - min(frame)) / 600.0E0, 6) AS minutes, round(count(DISTINCT floor(frame / 50)) / ((max(frame) - min(frame)) / 600.0E0), 6) AS pace FROM oncourt GROUP BY ALL")
def a10_pace(t):
    parts = t.select("clip_id", F.floor(F.col("frame") / 50).alias("part")).distinct()
    return reports.pace(parts, t, 10.0).select("clip_id", F.round("minutes", 6).alias("minutes"), F.round("pace", 6).alias("pace"))


@query("a11_mean_colors", "colors", sql="SELECT clip_id, track_id % 12 AS track_id, round(avg(c0), 6) AS c0, round(avg(c1), 6) AS c1, round(avg(c2), 6) AS c2, count(*) AS samples FROM colors GROUP BY ALL")
def a11_mean_colors(t):
    out = reports.mean_colors(t.withColumn("track_id", F.col("track_id") % 12), ["clip_id", "track_id"])
    return out.select("clip_id", "track_id", *(F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")), "samples")


@query("a27_located", "shots", "oncourt", sql="SELECT s.clip_id, count(*) FILTER (is_on) AS located, count(*) FILTER (is_on IS NULL OR NOT is_on) AS unlocated FROM shots s LEFT JOIN oncourt o ON s.clip_id = o.clip_id AND s.start_frame = o.frame AND s.track_id = o.track_id GROUP BY ALL")
def a27_located(s, o):
    return reports.located_counts(shots.locations(s, o))


@query("a29_use_shares", "oncourt", sql="SELECT clip_id, round_even(100.0E0 * count(*) FILTER (frame % 3 = 0 AND is_on) / nullif(count(*) FILTER (is_on), 0), 1) AS pct_of_readable, round_even(100.0E0 * count(*) FILTER (frame % 3 = 0 AND track_id < 6) / nullif(count(*) FILTER (track_id < 6), 0), 1) AS pct_of_labelled FROM oncourt GROUP BY ALL")
def a29_use_shares(t):
    return reports.use_shares(t.select("clip_id", F.col("is_on").alias("readable"), (F.col("track_id") < 6).alias("labelled"), (F.col("frame") % 3 == 0).alias("credited")))


@query("a31_compared", "oncourt", sql="""SELECT clip_id, b AS before, a AS after, CASE WHEN a - b > 0.05 THEN 'worse' WHEN a - b < -0.05 THEN 'better' ELSE 'same' END AS trend, CASE WHEN a - b > 0.05 THEN 'REGRESSION' WHEN clip_id % 3 = 0 THEN 'UNMEASURED' ELSE 'ok' END AS verdict
 FROM (SELECT clip_id, count(*) FILTER (NOT is_on AND frame % 2 = 0) / 10.0E0 AS b, count(*) FILTER (NOT is_on AND frame % 2 = 1) / 10.0E0 AS a FROM oncourt GROUP BY ALL)""")
def a31_compared(t):
    wrong = lambda k: t.groupBy("clip_id").agg((F.count_if(~F.col("is_on") & (F.col("frame") % 2 == k)) / 10).alias("wrong_seconds")).withColumn("check_can_fire", F.col("clip_id") % 3 != 0)
    return reports.compared(wrong(0), wrong(1))


@query("a33_queue_summary", "oncourt", sql="SELECT clip_id, count(*) FILTER (is_on AND track_id NOT IN (3, 5)) AS queued, count(*) FILTER (NOT is_on) AS off_court, count(*) FILTER (is_on AND track_id IN (3, 5)) AS excluded FROM oncourt GROUP BY ALL")
def a33_queue_summary(t):
    why = F.when(F.col("track_id") == 3, "ref").when(F.col("track_id") == 5, "bench")
    return reports.queue_summary(t.select("clip_id", F.col("is_on").alias("on_court"), why.alias("excluded")))


@query("a42_keyframe_plan", "tracks", sql="""SELECT clip_id, a, b, b - a AS gap, r AS ratio, coalesce(r < 0.5, true) AS weak FROM (SELECT clip_id, frame AS a, lead(frame) OVER (PARTITION BY clip_id ORDER BY frame) AS b, CASE WHEN frame % 7 <> 0 THEN (frame % 10) / 10.0E0 END AS r FROM (SELECT DISTINCT clip_id, frame FROM tracks)) WHERE b IS NOT NULL""")
def a42_keyframe_plan(t):
    keys = t.select("clip_id", F.col("frame").alias("keyframe")).distinct()
    nxt = reports.ranked(keys, ["clip_id"], F.col("keyframe"))
    a, b = nxt.select("clip_id", F.col("keyframe").alias("a"), "rank"), nxt.select("clip_id", F.col("keyframe").alias("b"), (F.col("rank") - 1).alias("rank"))
    ratio = F.when(F.col("a") % 7 != 0, (F.col("a") % 10) / 10)
    return reports.keyframe_plan(keys, a.join(b, ["clip_id", "rank"]).select("clip_id", "a", "b", ratio.alias("ratio")))


@query("t1_canonical_order", "oncourt", sql="SELECT clip_id, frame, track_id, CAST(row_number() OVER (PARTITION BY clip_id, frame ORDER BY court_x, court_y, track_id) AS INT) AS rank FROM oncourt")
def t1_canonical_order(t):
    return reports.ranked(t, ["clip_id", "frame"], F.col("court_x"), F.col("court_y"), F.col("track_id")).select("clip_id", "frame", "track_id", "rank")


@query("t2_queue_order", "shots", sql=f'SELECT clip_id, shot_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY "window", frame, coalesce(track_id, 0), shot_id) AS INT) AS rank FROM (SELECT *, {_W} FROM (SELECT *, start_frame AS frame FROM shots))')
def t2_queue_order(s):
    items = s.withColumn("frame", F.col("start_frame")).withColumn("window", team.fixed_window())
    return reports.ranked(items, ["clip_id"], F.col("window"), F.coalesce("frame", F.lit(0)), F.coalesce("track_id", F.lit(0)), F.col("shot_id")).select("clip_id", "shot_id", "rank")


@query("t4_top_zones", "oncourt", sql=f"SELECT * FROM (SELECT clip_id, zone, count(*) AS n, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, zone) AS INT) AS rank FROM (SELECT clip_id, {_ZONE} AS zone FROM (SELECT *, {_BX} AS bx FROM oncourt)) GROUP BY clip_id, zone) WHERE rank <= 3")
def t4_top_zones(t):
    n = t.groupBy("clip_id", X.zone_of("court_x", "court_y").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    return reports.ranked(n, ["clip_id"], F.col("n").desc(), F.col("zone")).where("rank <= 3")


@query("t6_shot_order", "shots", sql="SELECT clip_id, shot_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY start_frame, shot_id) AS INT) AS rank FROM shots")
def t6_shot_order(s):
    return reports.ranked(s, ["clip_id"], F.col("start_frame"), F.col("shot_id")).select("clip_id", "shot_id", "rank")


@query("t7_first_frames", "tracks", sql="SELECT clip_id, frame, track_id FROM tracks WHERE frame < 100")
def t7_first_frames(t):
    return reports.first_frames(t.select("clip_id", "frame", "track_id"), 100)


@query("u4_missing_frames", "tracks", "ball", sql="SELECT clip_id, frame FROM tracks EXCEPT SELECT clip_id, frame FROM ball")
def u4_missing_frames(t, b):
    return reports.missing_frames(t, b)


@query("u5_united_frames", "shots", "ball", sql="SELECT clip_id, unnest(range(start_frame, end_frame + 1)) AS frame FROM shots UNION SELECT clip_id, frame FROM ball WHERE conf >= 0.9")
def u5_united_frames(s, b):
    return reports.united_frames(s, b.where("conf >= 0.9"))


@query("p12_trusted_frames", "tracks", sql="SELECT clip_id, frame, CASE WHEN frame % 7 = 0 THEN 'low_confidence' END AS reason FROM (SELECT DISTINCT clip_id, frame FROM tracks)")
def p12_trusted_frames(t):
    frames = t.select("clip_id", "frame", F.when(F.col("frame") % 7 == 0, "low_confidence").otherwise("ok").alias("state")).distinct()
    good, skipped = reports.trusted_frames(frames)
    return good.select("clip_id", "frame", F.lit(None).cast("string").alias("reason")).unionByName(skipped.select("clip_id", "frame", "reason"))


@query("p13_above_floor", "ball", sql="SELECT f.clip_id, f.frame, d.det_idx FROM (SELECT DISTINCT clip_id, frame FROM ball) f LEFT JOIN (SELECT * FROM ball WHERE conf >= 0.10) d ON f.clip_id = d.clip_id AND f.frame = d.frame")
def p13_above_floor(b):
    return reports.above_floor(b).select("clip_id", "frame", "det_idx")


@query("p20_resolved_labels", "tracks", sql="""SELECT clip_id, track_id, CASE WHEN track_id NOT IN (2, 8, 9) THEN CASE WHEN track_id < 5 THEN 'h' || track_id ELSE 'c' || track_id END END AS label,
 CASE WHEN track_id IN (2, 9) THEN 'unlabeled' WHEN track_id = 8 THEN 'refused_spliced' ELSE 'labeled' END AS reason, track_id < 5 AS by_person FROM (SELECT DISTINCT clip_id, track_id FROM tracks)""")
def p20_resolved_labels(t):
    tid = F.col("track_id")
    tracks = t.select("clip_id", "track_id").distinct()
    config = tracks.where("track_id != 9").withColumn("label", F.when(tid == 8, "spliced").otherwise(F.concat(F.lit("c"), tid)))
    human = tracks.where("track_id < 5").withColumn("label", F.when(tid != 2, F.concat(F.lit("h"), tid)))
    return reports.resolved_labels(tracks, config, human)


@query("j2_with_teams", "tracks", sql="SELECT clip_id, frame, track_id, CASE WHEN track_id % 2 = 0 THEN 'team_a' ELSE 'team_b' END AS team FROM tracks WHERE track_id NOT IN (3, 5)")
def j2_with_teams(t):
    teams = t.select("clip_id", "track_id", F.when(F.col("track_id") % 2 == 0, "team_a").otherwise("team_b").alias("team")).distinct().where("track_id not in (3, 5)")
    return reports.with_teams(t.select("clip_id", "frame", "track_id"), teams)


@query("j7_overlapping_tracks", "tracks", "reads", sql="""SELECT DISTINCT t.clip_id, t.track_id FROM tracks t JOIN (SELECT t.clip_id, t.frame, x1 + 15 AS a, y1 + 10 AS b, x2 + 15 AS c, y2 + 10 AS d FROM tracks t JOIN reads r ON t.clip_id = r.clip_id AND t.frame = r.frame AND t.track_id = r.track_id WHERE conf >= 0.4) o ON t.clip_id = o.clip_id AND t.frame = o.frame
 WHERE greatest(0, least(x2, c) - greatest(x1, a)) * greatest(0, least(y2, d) - greatest(y1, b)) >= 0.5 * ((x2 - x1) * (y2 - y1) + (c - a) * (d - b) - greatest(0, least(x2, c) - greatest(x1, a)) * greatest(0, least(y2, d) - greatest(y1, b)))""")
def j7_overlapping_tracks(t, r):
    moved = t.join(r.select("clip_id", "frame", "track_id", "conf"), ["clip_id", "frame", "track_id"])
    boxes = moved.select("clip_id", "frame", *((F.col(c) + d).alias(f"b{c}") for c, d in (("x1", 15), ("y1", 10), ("x2", 15), ("y2", 10))), "conf")
    return reports.overlapping_tracks(t, boxes)


@query("j11_nearest_feet", "ball", "tracks", sql="""SELECT clip_id, frame, px, py, list(track_id ORDER BY d, track_id)[1] AS track_id, round(min(d), 6) AS dist FROM (SELECT b.clip_id, b.frame, b.cx AS px, b.cy AS py, t.track_id, sqrt(((x1+x2)/2-cx)*((x1+x2)/2-cx)+(y2-cy)*(y2-cy)) AS d FROM (SELECT DISTINCT clip_id, frame, cx, cy FROM ball) b JOIN tracks t ON b.clip_id = t.clip_id AND b.frame = t.frame) GROUP BY ALL""")
def j11_nearest_feet(b, t):
    spots = b.select("clip_id", "frame", F.col("cx").alias("px"), F.col("cy").alias("py")).distinct()
    return reports.nearest_feet(spots, t).withColumn("dist", F.round("dist", 6))


@query("j19_located_attempts", "shots", sql="SELECT clip_id, shot_id, CASE WHEN shot_id % 4 <> 0 THEN start_frame * 2 END AS place FROM shots")
def j19_located_attempts(s):
    places = s.where("shot_id % 4 != 0").select("clip_id", "start_frame", "end_frame", (F.col("start_frame") * 2).alias("place")).distinct()
    gone = s.where("shot_id % 4 = 0").select("clip_id", "start_frame", "end_frame")
    out = reports.located_attempts(s, places.join(gone, ["clip_id", "start_frame", "end_frame"], "left_anti").unionByName(places.join(gone, ["clip_id", "start_frame", "end_frame"], "left_semi")))
    return out.select("clip_id", "shot_id", F.when(F.col("shot_id") % 4 != 0, F.col("place")).alias("place"))


@query("j22_queue_identities", "reads", "tracks", sql=f"""SELECT clip_id, "window", identity_id, track_id, frame FROM (SELECT r.*, r.track_id % 7 AS identity_id, row_number() OVER (PARTITION BY clip_id, "window", track_id % 7 ORDER BY frame, track_id) AS k FROM (SELECT clip_id, {_W}, track_id, frame FROM reads) r WHERE track_id % 3 <> 0) WHERE k = 1""")
def j22_queue_identities(r, t):
    state = F.when(F.col("track_id") % 3 == 0, "confirmed").when(F.col("track_id") % 3 == 1, "candidate").otherwise("unknown")
    registry = t.select("clip_id", team.fixed_window(), "track_id", (F.col("track_id") % 7).alias("identity_id"), state.alias("final_state")).distinct()
    items = r.select("clip_id", team.fixed_window(), "track_id", "frame")
    return reports.queue_identities(items, registry).select("clip_id", "window", "identity_id", "track_id", "frame")


@query("h5_deflections", "shots", "tracks", sql=_HOOPS + """, c AS (SELECT clip_id, track_id AS chain, frame, (x1+x2)/2 - 500 AS cx, y1 - 250 AS cy FROM tracks),
m AS (SELECT s.clip_id, s.shot_id, s.hoop, c.chain, min(c.frame) AS frame, arg_min(cx, c.frame) AS sx, arg_min(cy, c.frame) AS sy FROM shots s JOIN c ON s.clip_id = c.clip_id AND c.frame > s.end_frame AND c.frame <= s.end_frame + 15 GROUP BY ALL),
d AS (SELECT m.*, sqrt((sx-hx)*(sx-hx)+(sy-hy)*(sy-hy)) AS d0 FROM m JOIN hoops USING (clip_id, frame, hoop)),
e AS (SELECT clip_id, chain, max(frame) AS f, arg_max(cx, frame) AS ex, arg_max(cy, frame) AS ey FROM c GROUP BY ALL),
g AS (SELECT d.clip_id, shot_id, d.chain, d.frame, d0, f, CASE WHEN h.hx IS NOT NULL THEN sqrt((ex-h.hx)*(ex-h.hx)+(ey-h.hy)*(ey-h.hy)) ELSE sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) END AS d1
 FROM d JOIN e ON d.clip_id = e.clip_id AND d.chain = e.chain AND f > d.frame LEFT JOIN hoops h ON h.clip_id = d.clip_id AND h.frame = f AND h.hoop = d.hoop WHERE d0 <= 100)
SELECT clip_id, shot_id, min(chain) AS chain, arg_min(frame, chain) AS start_frame, round_even(arg_min(d0, chain), 1) AS start_dist, arg_min(f, chain) AS end_frame, round_even(arg_min(d1, chain), 1) AS end_dist FROM g WHERE d1 >= 60 GROUP BY ALL""")
def h5_deflections(s, t):
    points = t.select("clip_id", F.col("track_id").alias("chain"), "frame", ((F.col("x1") + F.col("x2")) / 2 - 500).alias("cx"), (F.col("y1") - 250).alias("cy"))
    return reports.deflections(s, points, _hoops(t))


@query("h6_outcomes", "shots", "scores", sql="""SELECT clip_id, shot_id, CASE WHEN a AND NOT b THEN 'candidate_make' WHEN b AND NOT a THEN 'candidate_miss' ELSE 'unknown' END AS outcome, CASE WHEN a AND b THEN 'conflict' WHEN NOT a AND NOT b THEN 'no evidence' END AS reason
 FROM (SELECT s.clip_id, shot_id, count(c.frame) > 0 AS a, coalesce(s.track_id, 0) % 2 = 1 AS b FROM shots s LEFT JOIN scores c ON s.clip_id = c.clip_id AND c.frame BETWEEN end_frame AND end_frame + 60 GROUP BY s.clip_id, shot_id, s.track_id)""")
def h6_outcomes(s, c):
    return reports.outcomes(s, shots.made_nearby(s, c, 60).where("made"), s.where("coalesce(track_id, 0) % 2 = 1"))


@query("i1_unconfirmed_claims", "tracks", sql=_STATES + """ SELECT DISTINCT clip_id, "window", identity_id FROM ev WHERE state = 'confirmed' AND identity_id % 4 > 1""")
def i1_unconfirmed_claims(t):
    events = _states(t)
    k = F.col("identity_id") % 4
    how = F.when(k == 0, "seed").when(k == 1, "second_signal").when(k == 2, "position")
    return reports.unconfirmed_claims(events, events.select("clip_id", "window", "identity_id", how.alias("provenance")).distinct().where("provenance is not null"))


@query("i4_read_candidates", "tracks", "oncourt", sql=f"""SELECT DISTINCT t.clip_id, t."window", t.track_id FROM (SELECT clip_id, {_W}, track_id FROM tracks WHERE track_id % 3 = 1) t JOIN (SELECT clip_id, {_W}, track_id FROM oncourt GROUP BY clip_id, floor(frame / 60), track_id HAVING count(*) FILTER (is_on) > count(*) FILTER (NOT is_on)) o USING (clip_id, "window", track_id)""".replace(f"SELECT clip_id, {_W}, track_id FROM oncourt GROUP", 'SELECT clip_id, CAST(floor(frame / 60) AS BIGINT) AS "window", track_id FROM oncourt GROUP'))
def i4_read_candidates(t, o):
    k = F.col("track_id") % 3
    registry = t.select("clip_id", team.fixed_window(), "track_id", (k != 2).alias("ever_unresolved"), F.when(k == 0, "confirmed").otherwise("candidate").alias("final_state")).distinct()
    votes = identity.on_court_vote(o.withColumn("window", team.fixed_window()))
    return reports.read_candidates(registry, votes)[0].select("clip_id", "window", "track_id")


@query("i5_review_queue", "tracks", sql=f"""SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY "window", frame, track_id) AS INT) AS rank FROM (SELECT clip_id, "window", track_id AS identity_id, track_id, CASE WHEN track_id % 2 = 0 THEN 'candidate' ELSE 'unknown' END AS state, CASE WHEN track_id % 2 = 0 THEN max(frame) ELSE min(frame) END AS frame,
 CASE WHEN track_id % 2 = 0 THEN 'relinked at frame ' || max(frame) || ', never above candidate' ELSE 'no confirmed identity' END AS why FROM (SELECT clip_id, {_W}, track_id, frame FROM tracks) GROUP BY clip_id, "window", track_id)""")
def i5_review_queue(t):
    state = F.when(F.col("track_id") % 2 == 0, "candidate").otherwise("unknown")
    items = t.groupBy("clip_id", team.fixed_window(), "track_id").agg(F.max("frame").alias("relink_frame"), F.collect_set("frame").alias("recent"))
    return reports.review_queue(items.select("clip_id", "window", F.col("track_id").alias("identity_id"), "track_id", state.alias("state"), "relink_frame", "recent"))


@query("i8_presence", "tracks", sql=_STATES + """ SELECT clip_id, "window", identity_id, count(*) FILTER (state = 'confirmed') AS confirmed_frames, round(count(*) FILTER (state = 'confirmed') / 30.0E0, 6) AS seconds, count(*) FILTER (state <> 'confirmed') AS review_frames FROM ev GROUP BY ALL""")
def i8_presence(t):
    return reports.presence(_states(t)).withColumn("seconds", F.round("seconds", 6))


@query("i12_cross_checked", "reads", sql=f"""SELECT DISTINCT clip_id, {_W}, track_id, number, track_id * 7 % 50 AS labelled FROM reads WHERE number <> track_id * 7 % 50""")
def i12_cross_checked(r):
    labels = r.select("clip_id", "track_id", (F.col("track_id") * 7 % 50).alias("number")).distinct()
    return reports.cross_checked(labels, r.select("clip_id", team.fixed_window(), "track_id", "number").distinct()).select("clip_id", "window", "track_id", "number", "labelled")


@query("s20_stale_artifacts", "tracks", sql="SELECT clip_id, CASE WHEN clip_id % 4 = 3 THEN 'absent' WHEN clip_id % 4 = 1 THEN 'last' ELSE 'first,last' END AS differs FROM (SELECT DISTINCT clip_id FROM tracks) WHERE clip_id % 4 <> 0")
def s20_stale_artifacts(t):
    config = t.groupBy("clip_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    k = F.col("clip_id") % 4
    stored = config.where(k != 3).withColumn("last", F.when(k == 0, F.col("last"))).withColumn("first", F.when(k == 2, F.col("first") + 1).otherwise(F.col("first")))
    return reports.stale_artifacts(stored, config, ["first", "last"])


@query("s21_covering", "tracks", sql="SELECT clip_id, min(frame) AS start, max(frame) AS \"end\", clip_id % 2 AS anchors, clip_id % 3 <> 0 AS reusable FROM tracks GROUP BY clip_id")
def s21_covering(t):
    wanted = t.groupBy("clip_id").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), (F.col("clip_id") % 2).alias("anchors"))
    stored = wanted.withColumn("end", F.when(F.col("clip_id") % 3 == 0, F.col("end") - 1).otherwise(F.col("end") + 5))
    return reports.covering_artifacts(stored, wanted)


@query("s25_positions_only", "oncourt", sql="SELECT clip_id, frame, court_x, court_y, is_on FROM oncourt")
def s25_positions_only(o):
    return reports.positions_only(o)


@query("p8_guards", "oncourt", sql="""SELECT clip_id, frame, track_id, w * 0.9 > 0 AND court_x BETWEEN -1.5 AND 85.5 AND court_y BETWEEN -1.5 AND 51.5 AS on_floor, court_y < 46 AS on_screen, court_x BETWEEN -20 AND 60 AND court_y BETWEEN -15 AND 45 AS plausible FROM (SELECT *, CASE WHEN frame % 5 = 0 THEN -0.5 ELSE 0.5 END AS w FROM oncourt)""")
def p8_guards(o):
    x, y, w = F.col("court_x"), F.col("court_y"), F.when(F.col("frame") % 5 == 0, -0.5).otherwise(0.5)
    return o.select("clip_id", "frame", "track_id", reports.on_floor(x, y, w, 0.9).alias("on_floor"), reports.feet_on_screen(y, 50.0).alias("on_screen"), reports.plausible(x, y, 40.0, 30.0).alias("plausible"))


@query("p6_sign_fixed", "tracks", sql="SELECT clip_id, frame, track_id, CASE WHEN d < 0 THEN -x1 ELSE x1 END AS m0, CASE WHEN d < 0 THEN -d ELSE d END AS depth FROM (SELECT *, (CAST(frame % 3 AS DOUBLE) - 1) * 10 + 5 AS d FROM tracks)")
def p6_sign_fixed(t):
    zero = F.lit(0.0)
    m = [F.col("x1"), *[zero] * 5, ((F.col("frame") % 3).cast("double") - 1), zero, F.lit(5.0)]
    fixed = reports.sign_fixed(m, 10.0, 0.0)
    return t.select("clip_id", "frame", "track_id", fixed[0].alias("m0"), (fixed[6] * 10.0 + fixed[8]).alias("depth"))


@query("p18_p24_p27_scalars", "tracks", sql="""SELECT clip_id, frame, track_id, round(sqrt(greatest(x1 - 500, 0, 500 - x2) * greatest(x1 - 500, 0, 500 - x2) + greatest(y1 - 350, 0, 350 - y2) * greatest(y1 - 350, 0, 350 - y2)), 6) AS away, round_even(frame / 30.0E0, 3) AS t,
 100 + CAST('0x' || substr(md5(CAST(track_id AS VARCHAR)), 1, 2) AS INT) % 156 AS bucket FROM tracks""")
def p18_p24_p27_scalars(t):
    away = X.point_to_box(F.lit(500.0), F.lit(350.0), "x1", "y1", "x2", "y2")
    return t.select("clip_id", "frame", "track_id", F.round(away, 6).alias("away"), X.timestamp_s("frame", F.lit(30.0)).alias("t"), X.stable_bucket("track_id").alias("bucket"))


@query("u3_merge_verdicts", "tracks")
def u3_merge_verdicts(t):
    return merge.merge_verdicts(*_merge_input(t))


@query("u3_merged_events", "tracks")
def u3_merged_events(t):
    events, numbers, triggers = _merge_input(t)
    return merge.merged_events(events, stored(merge.merge_verdicts(events, numbers, triggers)))


def _merge_input(t):
    """Identities are tracks; read numbers vouch for tracks 1 mod 4, people for 2 and 3 mod 4, with rejections, repeats and clashes."""
    k = F.col("track_pos") % 3
    events = t.select("clip_id", team.fixed_window(), "frame", "track_id", F.col("track_id").alias("identity_id"), F.when(F.col("track_id") % 4 == 0, "confirmed").when(k == 0, "candidate").when(k == 1, "unknown").otherwise("lost").alias("state"))
    who = events.select("clip_id", "window", "identity_id").distinct()
    tid = F.col("identity_id")
    numbers = who.where("identity_id % 4 = 0").withColumn("number", tid)
    ocr = who.where("identity_id % 4 = 1").select("*", (tid * 3).alias("number"), F.lit("ocr").alias("source"), tid.alias("ord"))
    human = who.where("identity_id % 4 in (1, 2, 3)").select("*", F.when(tid != 6, F.when(tid % 4 == 1, tid * 3 + tid % 3).otherwise(tid - tid % 4)).alias("number"), F.lit("human").alias("source"), tid.alias("ord"))
    return events, numbers, ocr.unionByName(human)
