"""Registered queries of the tracking engine and their SQL.

Each reads an adapter table (``sources.adapters``) that Spark and DuckDB derive alike from the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.functions import exprs as X
from courtflow.operators import ball, colors, identity, quality, team
from courtflow.plans import box
from courtflow.plans.tables import stored
from courtflow.sources import adapters

FLAGSHIP = "a23_named_box"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``f(*adapter tables)``; in ``sql`` the adapters are tables of the same names."""

    def wrap(f):
        def run(spark, sf_dir: str) -> DataFrame:
            unique = adapters.unique_events(spark, sf_dir) if sum(map(adapters.from_events, tables)) > 2 else None
            return f(*(adapters.colors(spark, sf_dir) if t == "colors" else adapters.load(spark, sf_dir, t, unique) for t in tables))

        QUERIES[name] = run
        if sql:
            ctes = ", ".join(f"{t} AS ({adapters.SQL[t] if t != 'colors' else _COLORS})" for t in tables)
            ORACLE_SQL[name] = f"WITH {ctes} {sql}"
        return f

    return wrap


_COLORS = "SELECT vec_id % 8 AS clip_id, vec_id AS track_id, label % 2 AS team_hint, CAST(embedding[1] AS DOUBLE) AS c0, CAST(embedding[2] AS DOUBLE) AS c1, CAST(embedding[3] AS DOUBLE) AS c2 FROM embeddings"
_ZONE = """CASE WHEN court_y BETWEEN 19 AND 31 THEN CASE WHEN bx <= 19 THEN 'PAINT' WHEN bx <= 25 THEN 'TOP_OF_KEY' ELSE 'PERIMETER' END
 WHEN bx <= 14 THEN CASE WHEN court_y < 19 THEN 'LEFT_CORNER' ELSE 'RIGHT_CORNER' END
 WHEN bx <= 25 THEN CASE WHEN court_y < 19 THEN 'LEFT_WING' ELSE 'RIGHT_WING' END ELSE 'PERIMETER' END"""
_BX = "greatest(CASE WHEN court_x <= 42 THEN court_x ELSE 84 - court_x END, 0)"


@query("p15_zones", "oncourt", sql=f"SELECT clip_id, frame, track_id, {_ZONE} AS zone, CASE WHEN court_x < 28 THEN 'left' WHEN court_x >= 56 THEN 'right' ELSE 'middle' END AS third, court_x BETWEEN -3 AND 97 AND court_y BETWEEN -3 AND 53 AS inside FROM (SELECT *, {_BX} AS bx FROM oncourt)")
def p15_zones(t):
    return t.select("clip_id", "frame", "track_id", X.zone_of("court_x", "court_y").alias("zone"), X.third("court_x").alias("third"), X.in_court("court_x", "court_y", 94, 50, X.TEAM_MARGIN).alias("inside"))


@query("p16_shot_zones", "positions", sql="SELECT zone, count(*) AS n FROM (SELECT CASE WHEN d > 19.75 THEN 'three' WHEN d <= 8 THEN 'paint' ELSE 'midrange' END AS zone FROM (SELECT least(sqrt((court_x-5.25)*(court_x-5.25)+(court_y-25)*(court_y-25)), sqrt((court_x-78.75)*(court_x-78.75)+(court_y-25)*(court_y-25))) AS d FROM positions)) GROUP BY zone")
def p16_shot_zones(t):
    zone, _ = X.shot_zone("court_x", "court_y")
    return t.groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("p1_feet_points", "tracks", sql="SELECT clip_id, frame, track_id, (x1+x2)/2 AS fx, y2 AS fy, (y1+y2)/2 AS cy, y2-y1 AS h FROM tracks")
def p1_feet_points(t):
    fx, fy = X.feet_point("x1", "y1", "x2", "y2")
    return t.select("clip_id", "frame", "track_id", fx.alias("fx"), fy.alias("fy"), X.center("x1", "y1", "x2", "y2")[1].alias("cy"), (F.col("y2") - F.col("y1")).alias("h"))


@query("j1_projected_tracks", "tracks", sql="SELECT clip_id, frame, track_id, CASE WHEN frame % 40 <> 0 THEN (0.05*((x1+x2)/2)+0.0*y2+0.0)/(0.0*((x1+x2)/2)+0.0*y2+1.0) END AS court_x, CASE WHEN frame % 40 <> 0 THEN (0.0*((x1+x2)/2)+0.05*y2+0.0)/(0.0*((x1+x2)/2)+0.0*y2+1.0) END AS court_y FROM tracks")
def j1_projected_tracks(t):
    scale = [0.05, 0.0, 0.0, 0.0, 0.05, 0.0, 0.0, 0.0, 1.0]
    transforms = t.select("clip_id", "frame").distinct().where("frame % 40 != 0").select("clip_id", "frame", *(F.lit(v).alias(f"h{i}") for i, v in enumerate(scale)))
    fx, fy = X.feet_point("x1", "y1", "x2", "y2")
    x, y, _ = X.project([f"h{i}" for i in range(9)], fx, fy)
    return t.join(transforms, ["clip_id", "frame"], "left").select("clip_id", "frame", "track_id", x.alias("court_x"), y.alias("court_y"))


@query("a1_frame_means", "oncourt", sql="SELECT clip_id, frame, round(avg(CASE WHEN is_on THEN court_x END), 6) AS mean_x FROM oncourt GROUP BY ALL")
def a1_frame_means(t):
    return team.frame_means(t, F.col("is_on")).withColumn("mean_x", F.round("mean_x", 6))


@query("a2_heatmap", "positions", sql="SELECT clip_id, CAST(least(floor(court_x/2), 41) AS BIGINT) AS gx, CAST(least(floor(court_y/2), 24) AS BIGINT) AS gy, count(*) AS n FROM positions WHERE court_x BETWEEN 0 AND 84 AND court_y BETWEEN 0 AND 50 GROUP BY ALL")
def a2_heatmap(t):
    return team.heatmap(t).select("clip_id", F.col("gx").cast("long"), F.col("gy").cast("long"), "n")


@query("a3_coverage", "positions", sql="SELECT clip_id, team, count(DISTINCT greatest(least(CAST(trunc(court_x/5) AS INT), 18), 0)*10 + greatest(least(CAST(trunc(court_y/5) AS INT), 9), 0)) AS cells FROM positions GROUP BY ALL")
def a3_coverage(t):
    return team.coverage(t).drop("share")


@query("a4_spacing", "positions", sql="SELECT clip_id, team, round(avg(d), 6) AS spacing, count(*) AS frames FROM (SELECT a.clip_id, a.frame, a.team, avg(sqrt((a.court_x-b.court_x)*(a.court_x-b.court_x)+(a.court_y-b.court_y)*(a.court_y-b.court_y))) AS d FROM positions a JOIN positions b ON a.clip_id=b.clip_id AND a.frame=b.frame AND a.team=b.team AND a.track_id<b.track_id GROUP BY ALL) GROUP BY ALL")
def a4_spacing(t):
    return team.spacing(t).withColumn("spacing", F.round("spacing", 6))


@query("a5_zone_occupancy", "oncourt", sql=f"SELECT c.clip_id, z.zone, count(p.zone) AS n FROM (SELECT DISTINCT clip_id FROM oncourt) c CROSS JOIN (SELECT unnest(['PAINT','TOP_OF_KEY','PERIMETER','LEFT_CORNER','RIGHT_CORNER','LEFT_WING','RIGHT_WING']) AS zone) z LEFT JOIN (SELECT clip_id, {_ZONE} AS zone FROM (SELECT *, {_BX} AS bx FROM oncourt)) p ON p.clip_id=c.clip_id AND p.zone=z.zone GROUP BY ALL")
def a5_zone_occupancy(t):
    return team.zone_occupancy(t).drop("share")


@query("a6_mean_on_court", "oncourt", sql="SELECT clip_id, round(avg(n), 6) AS mean_on_court, count(*) AS frames FROM (SELECT clip_id, frame, count(*) FILTER (is_on) AS n FROM oncourt GROUP BY ALL) GROUP BY ALL")
def a6_mean_on_court(t):
    return team.mean_on_court(t).withColumn("mean_on_court", F.round("mean_on_court", 6))


@query("a7_thirds", "oncourt", sql="SELECT clip_id, frame, count(*) FILTER (court_x < 28) AS left_n, count(*) FILTER (court_x >= 28 AND court_x < 56) AS middle_n, count(*) FILTER (court_x >= 56) AS right_n, count(*) AS bodies FROM oncourt GROUP BY ALL")
def a7_thirds(t):
    return team.thirds(t)


@query("a8_on_court_vote", "oncourt", sql="SELECT clip_id, CAST(floor(frame/60) AS BIGINT) AS \"window\", track_id, count(*) FILTER (is_on) AS on_n, count(*) FILTER (NOT is_on) AS off_n, count(*) FILTER (is_on) > count(*) FILTER (NOT is_on) AS on_court FROM oncourt GROUP BY ALL")
def a8_on_court_vote(t):
    return identity.on_court_vote(t.withColumn("window", team.fixed_window()))


_RUNS = """, f AS (SELECT clip_id, frame, avg(court_x) AS m FROM oncourt GROUP BY ALL),
t AS (SELECT *, CASE WHEN m < 47 THEN 'left' ELSE 'right' END AS side FROM f),
g AS (SELECT *, CASE WHEN lag(side) OVER w <> side THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
r AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY clip_id, run ORDER BY frame) AS place FROM r),
k AS (SELECT clip_id, run, side, min(frame) AS a, max(CASE WHEN place = 30 THEN frame END) AS reached, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT *, coalesce(lag(side) OVER (PARTITION BY clip_id ORDER BY run) <> side, true) AS swing FROM k WHERE run = 0 OR n >= 30),
s AS (SELECT clip_id, run, side, CASE WHEN run = 0 THEN a ELSE reached END AS stands FROM h WHERE swing),
e AS (SELECT clip_id, max(frame) AS last FROM f GROUP BY ALL)"""


@query("w3_possessions", "oncourt", sql=_RUNS + ' SELECT s.clip_id, side, stands AS start, coalesce(lead(stands) OVER (PARTITION BY s.clip_id ORDER BY run), last) AS "end" FROM s JOIN e USING (clip_id)')
def w3_possessions(t):
    return team.possessions_v1(team.frame_means(t), hold=30)


_SIDES = """, f AS (SELECT clip_id, frame, avg(CASE WHEN is_on THEN court_x END) AS m FROM oncourt GROUP BY ALL),
t AS (SELECT clip_id, frame, CASE WHEN m < 36 THEN 'left' ELSE 'right' END AS side FROM f WHERE m < 36 OR m > 48),
g AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY clip_id ORDER BY frame) <> side THEN 1 ELSE 0 END AS new FROM t),
r AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM g),
k AS (SELECT clip_id, run, side, min(frame) AS a, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT *, coalesce(lag(side) OVER (PARTITION BY clip_id ORDER BY run) <> side, true) AS swing FROM k WHERE run = 0 OR n >= 15),
z AS (SELECT clip_id, max(frame) AS last FROM t GROUP BY ALL),
p AS (SELECT h.clip_id, side, a, coalesce(lead(a) OVER (PARTITION BY h.clip_id ORDER BY a) - 1, last) AS b, last, lag(a) OVER (PARTITION BY h.clip_id ORDER BY a) IS NULL OR lead(a) OVER (PARTITION BY h.clip_id ORDER BY a) IS NULL AS edge FROM h JOIN z USING (clip_id) WHERE swing),
s AS (SELECT *, coalesce(lag(side) OVER (PARTITION BY clip_id ORDER BY a) <> side, true) AS new FROM p WHERE edge OR b - a + 1 >= 40),
o AS (SELECT clip_id, side, a, coalesce(lead(a) OVER w - 1, last) AS b, lag(a) OVER w IS NULL AS pa, lead(a) OVER w IS NULL AS pb FROM s WHERE new WINDOW w AS (PARTITION BY clip_id ORDER BY a))"""


@query("w4_possessions", "oncourt", sql=_SIDES + ' SELECT o.clip_id, o.side, o.a AS start, o.b AS "end", round_even(avg(CASE WHEN t.side = o.side THEN 1.0E0 ELSE 0 END), 3) AS side_agreement, pa AS partial_start, pb AS partial_end FROM o JOIN t ON t.clip_id = o.clip_id AND t.frame BETWEEN o.a AND o.b GROUP BY ALL')
def w4_possessions(t):
    return team.possessions_v2(team.frame_means(t, F.col("is_on")), fps=10.0)


@query("w5_windows", "oncourt", sql=_SIDES + " SELECT clip_id, CASE WHEN pa THEN lo ELSE a END AS start, true AS from_possessions FROM o JOIN (SELECT clip_id, min(frame) AS lo FROM oncourt GROUP BY ALL) USING (clip_id)")
def w5_windows(t):
    spans = t.groupBy("clip_id").agg(F.min("frame").alias("span_start"), F.max("frame").alias("span_end"))
    return team.possession_windows(w4_possessions(t), spans)


@query("j6_windows", "tracks", "oncourt", sql="SELECT clip_id, frame, track_id, CAST(floor(frame / 70) AS BIGINT) AS \"window\" FROM tracks")
def j6_windows(t, o):
    starts = o.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(280).cast("long"), F.lit(70).cast("long"))).alias("start")).distinct()
    return team.window_of(t.select("clip_id", "frame", "track_id"), starts)


@query("w1_presence_spans", "tracks", sql="SELECT clip_id, track_id, 'seen' AS state, min(frame) AS start, max(frame) AS \"end\" FROM (SELECT *, frame - row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) AS i FROM tracks) GROUP BY clip_id, track_id, i")
def w1_presence_spans(t):
    return team.state_runs(t.select("clip_id", "track_id", "frame", F.lit("seen").alias("state")), ["clip_id", "track_id"])


@query("w2_presence_gaps", "tracks", sql="SELECT clip_id, track_id, p + 1 AS start, frame - 1 AS \"end\" FROM (SELECT *, lag(frame) OVER (PARTITION BY clip_id, track_id ORDER BY frame) AS p FROM tracks) WHERE frame - p > 1")
def w2_presence_gaps(t):
    return team.gaps(w1_presence_spans(t), ["clip_id", "track_id"])


@query("a16_purity", "reads", sql="""SELECT x.clip_id, x.track_id, CASE WHEN n IS NULL THEN 'no_evidence' WHEN n = 1 THEN 'consistent' ELSE 'spliced' END AS verdict, coalesce(n, 0) AS numbers, early, late, el > lf AS interleaved, CASE WHEN n > 1 THEN least(el, lf) END AS splice_from, CASE WHEN n > 1 THEN greatest(el, lf) END AS splice_to
 FROM (SELECT DISTINCT clip_id, track_id FROM reads) x LEFT JOIN (SELECT clip_id, track_id, count(*) AS n, list(number ORDER BY m, number)[1] AS early, list(number ORDER BY m, number)[-1] AS late, list(b ORDER BY m, number)[1] AS el, list(a ORDER BY m, number)[-1] AS lf
 FROM (SELECT clip_id, track_id, number, min(frame) AS a, max(frame) AS b, (min(frame) + max(frame)) / 2.0E0 AS m FROM reads WHERE conf >= 0.85 GROUP BY ALL) GROUP BY ALL) y ON x.clip_id = y.clip_id AND x.track_id = y.track_id""")
def a16_purity(t):
    return identity.purity(t)


@query("a17_readability", "reads", sql="SELECT clip_id, count(*) AS attempts, count(*) FILTER (conf >= 0.85) AS confident, round(count(*) FILTER (conf >= 0.85) / CAST(count(*) AS DOUBLE), 6) AS rate FROM reads GROUP BY ALL")
def a17_readability(t):
    return identity.readability(t).withColumn("rate", F.round("rate", 6))


@query("a18_best_reads", "reads", sql="SELECT clip_id, \"window\", track_id, number, conf, frame FROM (SELECT *, CAST(floor(frame/60) AS BIGINT) AS \"window\", row_number() OVER (PARTITION BY clip_id, floor(frame/60), track_id ORDER BY conf DESC, frame) AS r FROM reads WHERE conf >= 0.85) WHERE r = 1")
def a18_best_reads(t):
    return identity.best_reads(t.withColumn("window", team.fixed_window()))


@query("i3_second_signal", "tracks", "reads", sql="""SELECT t.clip_id, t."window", t.track_id, expected, number, CASE WHEN expected IS NULL THEN 'no_position_hypothesis' WHEN number IS NULL THEN 'no_confident_read' WHEN number = expected THEN 'agree' ELSE 'disagree' END AS outcome FROM
 (SELECT DISTINCT clip_id, CAST(floor(frame/60) AS BIGINT) AS "window", track_id, CASE WHEN track_id <> 3 THEN track_id*7%50 END AS expected FROM tracks) t LEFT JOIN
 (SELECT clip_id, CAST(floor(frame/60) AS BIGINT) AS "window", track_id, arg_max(number, conf*1000 - frame/1000.0) AS number FROM reads WHERE conf >= 0.85 GROUP BY ALL) b USING (clip_id, "window", track_id)""")
def i3_second_signal(t, r):
    candidates = t.select("clip_id", team.fixed_window(), "track_id", F.when(F.col("track_id") != 3, F.col("track_id") * 7 % 50).alias("expected")).distinct()
    return identity.second_signal(candidates, a18_best_reads(r).select("clip_id", "window", "track_id", "number"))


@query("u2_dual_numbers", "tracks", sql="SELECT clip_id, number, count(DISTINCT team) AS teams FROM (SELECT clip_id, track_id*7%50 AS number, track_id%2 AS team FROM tracks UNION ALL SELECT clip_id, 7, track_id%2 FROM tracks) GROUP BY ALL HAVING count(DISTINCT team) > 1")
def u2_dual_numbers(t):
    rosters = t.select("clip_id", (F.col("track_id") * 7 % 50).alias("number"), (F.col("track_id") % 2).alias("team"))
    return identity.dual_numbers(rosters.unionByName(t.select("clip_id", F.lit(7).cast("long").alias("number"), (F.col("track_id") % 2).alias("team"))))


@query("p19_labels", "tracks", sql="SELECT DISTINCT clip_id, track_id, CASE track_id WHEN 3 THEN 'ref' WHEN 5 THEN 'bench' WHEN 8 THEN 'spliced' WHEN 11 THEN 'refused' ELSE 'number' END AS kind FROM tracks")
def p19_labels(t):
    tid = F.col("track_id")
    label = F.when(tid == 3, "ref").when(tid == 5, "bench").when(tid == 8, "spliced").when(tid == 11, "99").otherwise((tid * 7 % 50).cast("string"))
    labels = t.select("clip_id", "track_id", label.alias("label")).distinct()
    return identity.typed_labels(labels, t.select("clip_id", (tid * 7 % 50).alias("number"))).select("clip_id", "track_id", "kind")


@query("st1_identity_events", "tracks")
def st1_identity_events(t):
    return identity.with_identity_ids(identity.identity_runs(t.withColumn("window", team.fixed_window())))


@query("a23_box_score", "tracks", "oncourt")
def a23_box_score(t, o):
    return box.seeded_box_score(t, o)


@query("st3_chains", "ball")
def st3_chains(t):
    return ball.chain_points(t)


@query("a20_chain_verdicts", "ball")
def a20_chain_verdicts(t):
    points = stored(ball.chain_points(t))
    return ball.chain_verdicts(points, ball.arcs(points))


@query("h1_shot_attempts", "ball")
def h1_shot_attempts(t):
    points = stored(ball.chain_points(t.where("conf >= 0.10")))
    frames = t.select("clip_id", "frame").distinct().where("frame % 17 != 0")
    spots = F.array(F.struct(F.lit("far").alias("hoop"), F.lit(850.0).alias("hx"), F.lit(120.0).alias("hy")), F.struct(F.lit("near").alias("hoop"), F.lit(300.0).alias("hx"), F.lit(130.0).alias("hy")))
    return ball.shot_attempts(stored(ball.arcs(points)), points, frames.select("clip_id", "frame", F.explode(spots).alias("s")).select("clip_id", "frame", "s.*"))


@query("a22_fragmentation", "tracks", sql="SELECT a.clip_id, ids, round(lifespan, 6) AS lifespan, round(tracks_per_frame, 6) AS tracks_per_frame FROM (SELECT clip_id, count(*) AS ids, avg(n) AS lifespan FROM (SELECT clip_id, track_id, count(*) AS n FROM tracks GROUP BY ALL) GROUP BY ALL) a JOIN (SELECT clip_id, avg(n) AS tracks_per_frame FROM (SELECT clip_id, frame, count(*) AS n FROM tracks GROUP BY ALL) GROUP BY ALL) b USING (clip_id)")
def a22_fragmentation(t):
    return quality.fragmentation(t).select("clip_id", "ids", F.round("lifespan", 6).alias("lifespan"), F.round("tracks_per_frame", 6).alias("tracks_per_frame"))


@query("w9_reattach_gaps", "tracks", sql="SELECT * FROM (SELECT clip_id, track_id, frame, frame - lag(frame) OVER (PARTITION BY clip_id, track_id ORDER BY frame) - 1 AS gap FROM tracks) WHERE gap >= 3")
def w9_reattach_gaps(t):
    return quality.reattach_gaps(t)


@query("a32_densest_frames", "tracks", sql="SELECT * FROM (SELECT clip_id, frame, count(*) AS n, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, frame) AS INT) AS rank FROM tracks GROUP BY clip_id, frame) WHERE rank <= 60")
def a32_densest_frames(t):
    return quality.densest_frames(t)


@query("a37_step_profile", "oncourt", sql="SELECT clip_id, round(quantile_cont(step, 0.5), 6) AS median, round(quantile_cont(step, 0.95), 6) AS p95, round(max(step), 6) AS longest FROM (SELECT clip_id, sqrt((court_x-px)*(court_x-px)+(court_y-py)*(court_y-py)) AS step FROM (SELECT *, lag(court_x) OVER w AS px, lag(court_y) OVER w AS py FROM oncourt WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame))) WHERE step IS NOT NULL GROUP BY ALL")
def a37_step_profile(t):
    return quality.step_profile(t).select("clip_id", *(F.round(c, 6).alias(c) for c in ("median", "p95", "longest")))


@query("j5_nearest_keyframe", "tracks", sql="SELECT clip_id, frame, arg_min(k, abs(k - frame) * 1000 + k / 1000.0) AS keyframe FROM (SELECT DISTINCT clip_id, frame FROM tracks), (SELECT unnest([0, 45, 100, 160, 230]) AS k) GROUP BY ALL")
def j5_nearest_keyframe(t):
    keys = t.select("clip_id").distinct().select("clip_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 45, 100, 160, 230)))).alias("keyframe"))
    return quality.nearest_keyframe(t, keys)


@query("w11_tallest_crops", "tracks", sql="SELECT clip_id, track_id, slice, frame, h FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, track_id, slice ORDER BY h DESC, frame) AS r FROM (SELECT *, CAST(floor(i / greatest(floor(n / 6.0), 1)) AS BIGINT) AS slice FROM (SELECT clip_id, track_id, frame, y2 - y1 AS h, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip_id, track_id) AS n FROM tracks WHERE y2 - y1 >= 90))) WHERE r = 1")
def w11_tallest_crops(t):
    return quality.tallest_crops(t)


@query("w14_spread_sample", "tracks", sql="SELECT clip_id, track_id, frame FROM (SELECT clip_id, track_id, frame, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip_id, track_id) AS n FROM tracks) WHERE n <= 6 OR i IN (0, floor(n/6.0), floor(2*n/6.0), floor(3*n/6.0), floor(4*n/6.0), floor(5*n/6.0))")
def w14_spread_sample(t):
    return quality.spread_sample(t, ["clip_id", "track_id"], "frame")


@query("a38_seen_profile", "tracks", "ball", sql="SELECT clip_id, count(*) AS frames, count(*) FILTER (n > 0) AS seen, CAST(sum(n) AS BIGINT) AS dets, CAST(sum(CASE WHEN (n > 0) <> (p > 0) THEN 1 ELSE 0 END) AS BIGINT) AS flips FROM (SELECT *, lag(n) OVER (PARTITION BY clip_id ORDER BY frame) AS p FROM (SELECT t.clip_id, t.frame, count(b.frame) AS n FROM (SELECT DISTINCT clip_id, frame FROM tracks) t LEFT JOIN ball b ON t.clip_id=b.clip_id AND t.frame=b.frame GROUP BY ALL)) GROUP BY ALL")
def a38_seen_profile(t, b):
    return quality.seen_profile(t, b)


@query("s24_misaligned", "tracks", "ball", sql="SELECT clip_id, frame, 'a' AS only_in FROM (SELECT DISTINCT clip_id, frame FROM tracks EXCEPT SELECT clip_id, frame FROM ball)")
def s24_misaligned(t, b):
    return quality.misaligned(t, b)


@query("s19_sampled_frames", "ball", sql="SELECT w.clip_id, w.frame, b.frame IS NULL AS missing FROM (SELECT clip_id, unnest(range(min(frame), max(frame) + 1, 5)) AS frame FROM ball GROUP BY clip_id) w LEFT JOIN (SELECT DISTINCT clip_id, frame FROM ball) b ON b.clip_id=w.clip_id AND b.frame=w.frame")
def s19_sampled_frames(b):
    return quality.sampled_frames(b, 5)


@query("st7_score_changes", "reads")
def st7_score_changes(t):
    board = t.groupBy("clip_id", "frame").agg((F.max("track_id") % 3 + F.floor(F.max("frame") / 60) * 2).cast("long").alias("home"), F.floor(F.max("frame") / 50).cast("long").alias("away"))
    return quality.debounced_scores(board)


@query("a12_centroids", "colors", sql="SELECT clip_id, team_hint, round(avg(c0), 6) AS c0, round(avg(c1), 6) AS c1, round(avg(c2), 6) AS c2, count(*) AS n FROM colors GROUP BY ALL")
def a12_centroids(t):
    return colors.centroids(t).select("clip_id", "team_hint", *(F.round(c, 6).alias(c) for c in colors.C), "n")


@query("a13_nearest_team", "colors", sql="""SELECT clip_id, track_id, CASE WHEN d2 >= 1.4 * greatest(d1, 1e-6) THEN t1 END AS team FROM (SELECT clip_id, track_id, list(d ORDER BY d)[1] AS d1, list(d ORDER BY d)[2] AS d2, list(t ORDER BY d)[1] AS t1 FROM
 (SELECT x.clip_id, x.track_id, m.team_hint AS t, sqrt((x.c0-m.c0)*(x.c0-m.c0)+(x.c1-m.c1)*(x.c1-m.c1)+(x.c2-m.c2)*(x.c2-m.c2)) AS d FROM colors x JOIN (SELECT clip_id, team_hint, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2 FROM colors GROUP BY ALL) m USING (clip_id)) GROUP BY ALL)""")
def a13_nearest_team(t):
    return colors.nearest_team(t, colors.centroids(t)).drop("dist")


@query("a15_two_clusters", "colors")
def a15_two_clusters(t):
    return colors.two_clusters(t)
