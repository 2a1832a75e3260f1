"""Registered queries of seeding, resolutions, merges and the flagship, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.operators import audit, colors, duals, identity, merge, quality, reports, resolutions, seeding, shots, team
from courtflow.plans import box
from courtflow.queries import _SIDES, query
from courtflow.report_queries import _STATES, _W, _states

_FPS = 10.0
_ALL = ("tracks", "oncourt", "reads", "labels_typed", "rosters")

_SEEDS = _SIDES + """,
st AS (SELECT clip_id, CASE WHEN pa THEN lo ELSE a END AS start FROM o JOIN (SELECT clip_id, min(frame) AS lo FROM oncourt GROUP BY ALL) USING (clip_id)),
wt AS (SELECT t.clip_id, t.frame, t.track_id, CAST(greatest(count(st.start) - 1, 0) AS BIGINT) AS win FROM tracks t LEFT JOIN st ON st.clip_id = t.clip_id AND st.start <= t.frame GROUP BY ALL),
wo AS (SELECT t.clip_id, t.frame, t.track_id, t.is_on, CAST(greatest(count(st.start) - 1, 0) AS BIGINT) AS win FROM oncourt t LEFT JOIN st ON st.clip_id = t.clip_id AND st.start <= t.frame GROUP BY ALL),
vote AS (SELECT clip_id, win, track_id FROM wo GROUP BY ALL HAVING count(*) FILTER (is_on) > count(*) FILTER (NOT is_on)),
typed AS (SELECT l.clip_id, l.track_id, r.number, label IN ('ref', 'bench', 'spliced') AS odd FROM labels_typed l LEFT JOIN (SELECT DISTINCT clip_id, number FROM rosters) r ON r.clip_id = l.clip_id AND CAST(r.number AS VARCHAR) = l.label),
spliced AS (SELECT clip_id, track_id FROM reads WHERE conf >= 0.85 GROUP BY ALL HAVING count(DISTINCT number) > 1),
fr AS (SELECT clip_id, win, track_id, min(frame) AS f FROM wt GROUP BY ALL),
sw AS (SELECT clip_id, win, min(frame) AS s FROM wt GROUP BY ALL),
seed AS (SELECT clip_id, win, track_id, CASE WHEN f = s THEN 'seed' ELSE 'late seed' END AS reason, number FROM fr JOIN sw USING (clip_id, win) JOIN vote USING (clip_id, win, track_id) LEFT JOIN typed USING (clip_id, track_id)
  ANTI JOIN spliced USING (clip_id, track_id) WHERE NOT coalesce(odd, false) AND (f = s OR number IS NOT NULL))"""


@query("i2_w7_seeds", *_ALL, sql=_SEEDS + ' SELECT clip_id, win AS "window", track_id, reason FROM seed')
def i2_w7_seeds(t, o, r, labels, rosters):
    return box.window_seeds(t, o, r, labels, rosters, _FPS)[1]


_LIVE = """,
spine AS (SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS ord FROM (SELECT DISTINCT clip_id, frame FROM tracks)),
isl AS (SELECT wt.*, ord - row_number() OVER (PARTITION BY wt.clip_id, win, track_id ORDER BY wt.frame) AS g FROM wt JOIN spine ON spine.clip_id = wt.clip_id AND spine.frame = wt.frame),
live AS (SELECT i.clip_id, i.frame, i.win, i.track_id, s.number FROM (SELECT *, min(g) OVER (PARTITION BY clip_id, win, track_id) AS g0 FROM isl) i JOIN seed s USING (clip_id, win, track_id) WHERE g = g0 AND s.number IS NOT NULL),
claim AS (SELECT clip_id, number, frame, count(*) > 1 AS disputed, min(win) AS win, min(track_id) AS track_id FROM live GROUP BY ALL),
nt AS (SELECT clip_id, number, CASE WHEN count(DISTINCT team) > 1 THEN 'AMBIGUOUS (team_a / team_b)' ELSE min(team) END AS team FROM rosters GROUP BY ALL)
SELECT c.clip_id, c.number, nt.team, count(*) FILTER (NOT disputed) AS live, count(*) FILTER (disputed) AS disputed_frames, count(DISTINCT CASE WHEN NOT disputed THEN win END) AS windows_present
FROM claim c JOIN nt ON nt.clip_id = c.clip_id AND nt.number = c.number GROUP BY ALL HAVING count(*) FILTER (NOT disputed) > 0 OR nt.team LIKE 'AMB%'"""


@query("a23_live_lines", *_ALL, sql=_SEEDS + _LIVE)
def a23_live_lines(t, o, r, labels, rosters):
    """The flagship's lines before merges: live frames only, which islands in SQL tell as well."""
    run = box.identify(t, o, r, labels, rosters, _FPS)
    lines = identity.box_score(run.events, run.registry, o, 1.0, rosters=rosters)
    return lines.select("clip_id", "number", "team", F.col("seconds_live").cast("long").alias("live"), "disputed_frames", F.col("windows_present").cast("long").alias("windows_present"))


@query("a23_named_box", *_ALL, "crops")
def a23_named_box(t, o, r, labels, rosters, crops):
    """The flagship."""
    return box.named_box_score(t, o, r, labels, rosters, crops, _FPS)


@query("a23_summary", *_ALL)
def a23_summary(t, o, r, labels, rosters):
    """The flagship's report by clip: nameless identities, events that wait for review, readable seconds."""
    run = box.identify(t, o, r, labels, rosters, _FPS)
    return identity.box_summary(box.credited(run), run.registry, o, run.excluded, _FPS)


@query("a23_state_summary", "tracks", "oncourt", sql=_STATES + """,
x AS (SELECT *, CASE WHEN identity_id % 5 <> 2 THEN identity_id % 5 END AS number FROM ev),
n AS (SELECT clip_id, count(DISTINCT CASE WHEN state <> 'candidate' AND number IS NULL THEN "window" * 1000 + identity_id END) AS unnamed_identities, count(*) FILTER (state <> 'candidate' AND number IS NULL) / 30.0E0 AS unnamed_seconds,
  count(*) FILTER (state = 'candidate') AS candidate_events, count(*) FILTER (state = 'unknown') AS unknown_events FROM x GROUP BY ALL)
SELECT n.*, round_even(r.k / 30.0E0, 1) AS readable_seconds FROM n JOIN (SELECT clip_id, count(*) AS k FROM oncourt WHERE is_on AND track_id NOT IN (3, 5) GROUP BY ALL) r USING (clip_id)""")
def a23_state_summary(t, o):
    events = _states(t)
    numbers = events.where("identity_id % 5 <> 2").select("clip_id", "window", "identity_id", (F.col("identity_id") % 5).alias("number")).distinct()
    return identity.box_summary(events, numbers, o, t.where("track_id in (3, 5)").select("clip_id", "track_id"))


@query("i3_outcomes", *_ALL)
def i3_outcomes(t, o, r, labels, rosters):
    """What reads say of the identities of the flagship's run."""
    return box.identify(t, o, r, labels, rosters, _FPS).outcomes


_CLAIMS = _STATES + """,
nt AS (SELECT clip_id, number, min(team) AS team, count(DISTINCT team) > 1 AS several FROM rosters GROUP BY ALL),
c AS (SELECT ev.clip_id, ev."window", identity_id, nt.number, frame, track_id, several, team FROM ev JOIN nt ON nt.clip_id = ev.clip_id AND nt.number = identity_id * 7 % 50 WHERE state <> 'candidate'),
k AS (SELECT *, row_number() OVER g - 1 AS i, count(*) OVER (PARTITION BY clip_id, "window", identity_id, number) AS n FROM c WINDOW g AS (PARTITION BY clip_id, "window", identity_id, number ORDER BY frame, track_id)),
s AS (SELECT k.*, c0, c1, c2 FROM k JOIN crops p ON p.clip_id = k.clip_id AND p.frame = k.frame AND p.track_id = k.track_id WHERE n <= 6 OR i IN (0, n // 6, 2 * n // 6, 3 * n // 6, 4 * n // 6, 5 * n // 6)),
m AS (SELECT clip_id, team, avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2 FROM s WHERE NOT several GROUP BY ALL),
d AS (SELECT s.clip_id, s."window", identity_id, number, frame, m.team, sqrt((c0-m0)*(c0-m0) + (c1-m1)*(c1-m1) + (c2-m2)*(c2-m2)) AS d FROM s JOIN m ON m.clip_id = s.clip_id WHERE several),
v AS (SELECT clip_id, "window", identity_id, number, CASE WHEN list(d ORDER BY d)[2] >= 1.4 * greatest(list(d ORDER BY d)[1], 1e-6) THEN list(team ORDER BY d)[1] END AS team FROM d GROUP BY clip_id, "window", identity_id, number, frame),
u AS (SELECT clip_id, "window", identity_id, number, count(*) FILTER (team = 'team_a') AS a, count(*) FILTER (team = 'team_b') AS b FROM v GROUP BY ALL)
SELECT clip_id, "window", identity_id, number, CASE WHEN a > b THEN 'team_a' WHEN b > a THEN 'team_b' END AS team FROM u"""


@query("i9_dual_teams", "tracks", "rosters", "crops", sql=_CLAIMS)
def i9_dual_teams(t, rosters, crops):
    events = _states(t)
    numbers = events.select("clip_id", "window", "identity_id", (F.col("identity_id") * 7 % 50).alias("number")).distinct()
    return duals.dual_teams(events, numbers, rosters, crops)


_RESOLVED = """, f AS (SELECT DISTINCT clip_id, CAST(floor(frame / 60) AS BIGINT) AS "window", track_id FROM tracks WHERE track_id % 3 <> 0),
x AS (SELECT clip_id, "window", track_id, CASE WHEN track_id % 5 = 0 THEN 'reject' WHEN track_id = 4 THEN '4' ELSE CAST(track_id * 7 % 50 AS VARCHAR) END AS number, CASE WHEN track_id = 7 THEN 'blurred' END AS needs_review, clip_id % 4 = 3 AS stale, track_id AS ord FROM f
 UNION ALL SELECT DISTINCT clip_id, CAST(floor(frame / 60) AS BIGINT), CASE WHEN track_id = 9 THEN 99 END, 'reject', NULL, clip_id % 4 = 3, 100 + track_id FROM tracks WHERE track_id IN (6, 9)),
j AS (SELECT x.*, CASE WHEN stale THEN 'windows have moved' WHEN needs_review IS NOT NULL THEN 'needs review: ' || needs_review WHEN x.number <> 'reject' AND r.number IS NULL THEN 'off roster' WHEN x.track_id IS NULL THEN 'no track' WHEN x.track_id = 99 THEN 'track not in the window' END AS reason
 FROM x LEFT JOIN (SELECT DISTINCT clip_id, CAST(number AS VARCHAR) AS number FROM rosters) r ON r.clip_id = x.clip_id AND r.number = x.number)
SELECT clip_id, "window", track_id, number, ord, CASE WHEN reason IS NULL THEN track_id + 1000 END AS identity_id, CASE WHEN reason IS NULL THEN 'applied' ELSE 'refused' END AS status, reason FROM j"""


def _resolutions(t):
    """Resolutions of two tracks in three: rejections, an off-roster number, a note, a lost track, one that no window has, and clips with moved windows."""
    tid, stale = F.col("track_id"), F.when(F.col("clip_id") % 4 == 3, F.array(F.lit(0), F.lit(50)).cast("array<long>")).otherwise(F.col("starts"))
    starts = t.groupBy("clip_id").agg(F.collect_set(F.floor(F.col("frame") / 60) * 60).alias("starts"))
    who = t.select("clip_id", team.fixed_window(), "track_id").distinct().join(starts.hint("merge"), "clip_id")
    number = F.when(tid % 5 == 0, "reject").when(tid == 4, "4").otherwise((tid * 7 % 50).cast("string"))
    some = who.where("track_id % 3 <> 0").select("clip_id", "window", "track_id", number.alias("number"), F.when(tid == 7, "blurred").alias("needs_review"), stale.alias("made_against"), tid.alias("ord"))
    lost = who.where("track_id in (6, 9)").select("clip_id", "window", F.when(tid == 9, F.lit(99)).cast("long").alias("track_id"), F.lit("reject").alias("number"), F.lit(None).cast("string").alias("needs_review"), stale.alias("made_against"), (tid + 100).alias("ord"))
    return some.unionByName(lost)


@query("i6_resolutions", "tracks", "rosters", sql=_RESOLVED)
def i6_resolutions(t, rosters):
    events = t.select("clip_id", team.fixed_window(), "frame", "track_id", (F.col("track_id") + 1000).alias("identity_id"))
    starts = t.select("clip_id", (F.floor(F.col("frame") / 60) * 60).alias("start")).distinct()
    return resolutions.checked(_resolutions(t), starts, rosters, events)


@query("i7_rekeyed", "tracks", sql=f"""SELECT DISTINCT clip_id, "window", identity_id, CASE WHEN identity_id < 4 THEN identity_id WHEN identity_id < 90 AND n = 1 THEN t END AS track_id,
 CASE WHEN identity_id < 4 THEN NULL WHEN identity_id >= 90 THEN 'identity is not in the run' WHEN n > 1 THEN 'identity spans ' || n || ' tracks' END AS needs_review,
 CASE WHEN identity_id < 4 THEN 'kept' WHEN identity_id >= 90 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'migrated' END AS status
 FROM (SELECT clip_id, "window", track_id % 8 AS identity_id, count(DISTINCT track_id) AS n, min(track_id) AS t FROM (SELECT *, {_W} FROM tracks) GROUP BY ALL
  UNION ALL SELECT DISTINCT clip_id, {_W}, 90, 0, 0 FROM tracks)""")
def i7_rekeyed(t):
    events = t.select("clip_id", team.fixed_window(), "frame", "track_id", (F.col("track_id") % 8).alias("identity_id"))
    who = events.select("clip_id", "window", "identity_id").distinct()
    asked = who.unionByName(who.select("clip_id", "window", F.lit(90).cast("long").alias("identity_id")).distinct())
    rows = asked.select("*", F.when(F.col("identity_id") < 4, F.col("identity_id")).alias("track_id"), F.lit(None).cast("string").alias("needs_review"))
    return resolutions.rekeyed_file(rows, events)


@query("u3_sole_verdicts", "tracks", sql=f""", ev AS (SELECT clip_id, {_W}, frame, track_id, CASE WHEN track_id % 4 = 0 THEN 'confirmed' WHEN track_pos % 3 = 0 THEN 'candidate' WHEN track_pos % 3 = 1 THEN 'unknown' ELSE 'lost' END AS state FROM tracks),
q AS (SELECT DISTINCT clip_id, "window", track_id, CASE WHEN track_id % 4 = 1 THEN track_id * 3 ELSE track_id - 2 END AS number, track_id % 4 = 1 AS ocr FROM ev WHERE track_id % 4 IN (1, 2)),
fr AS (SELECT q.clip_id, q."window", q.track_id, q.number, ocr, e.frame, c.frame IS NOT NULL AS clash FROM q LEFT JOIN ev e ON e.clip_id = q.clip_id AND e."window" = q."window" AND e.track_id = q.track_id AND (e.state = 'candidate' OR (e.state = 'unknown' AND NOT ocr))
 LEFT JOIN ev c ON c.clip_id = q.clip_id AND c."window" = q."window" AND c.track_id = q.number AND c.frame = e.frame AND c.state = 'confirmed')
SELECT clip_id, "window", track_id AS identity_id, number, CASE WHEN ocr THEN 'ocr' ELSE 'human' END AS source, CASE WHEN count(*) FILTER (clash) > 0 THEN 'contradiction' ELSE 'merged' END AS verdict,
 CASE WHEN count(*) FILTER (clash) > 0 THEN 0 ELSE count(frame) END AS n_frames, count(*) FILTER (clash) AS n_overlap FROM fr GROUP BY ALL""")
def u3_sole_verdicts(t):
    """Triggers that share neither number nor identity: the part of U3 that is a join."""
    tid, k = F.col("track_id"), F.col("track_pos") % 3
    state = F.when(tid % 4 == 0, "confirmed").when(k == 0, "candidate").when(k == 1, "unknown").otherwise("lost")
    events = t.select("clip_id", team.fixed_window(), "frame", "track_id", tid.alias("identity_id"), state.alias("state"))
    who = events.select("clip_id", "window", "identity_id").distinct()
    one = F.col("identity_id") % 4 == 1
    asked = who.where("identity_id % 4 in (1, 2)").select("*", F.when(one, F.col("identity_id") * 3).otherwise(F.col("identity_id") - 2).alias("number"), F.when(one, "ocr").otherwise("human").alias("source"), F.col("identity_id").alias("ord"))
    told = merge.merge_verdicts(events, who.where("identity_id % 4 = 0").withColumn("number", F.col("identity_id")), asked)
    return told.select("clip_id", "window", "identity_id", "number", "source", "verdict", "n_frames", "n_overlap")


@query("u3_flagship_verdicts", *_ALL)
def u3_flagship_verdicts(t, o, r, labels, rosters):
    """Reads and people's resolutions merged into the flagship's run."""
    run = box.identify(t, o, r, labels, rosters, _FPS)
    starts = box.possession_starts(o, _FPS)
    told = resolutions.checked(_resolutions(t).where("needs_review is null").withColumn("made_against", F.lit(None).cast("array<long>")), starts, rosters, run.events)
    triggers = seeding.agree_triggers(run.outcomes).unionByName(resolutions.human_triggers(told))
    return merge.merge_verdicts(run.events, run.registry.where("number is not null"), box.stored(triggers))


@query("t3_ordered_lines", *_ALL, sql=_SEEDS + _LIVE.replace("SELECT c.clip_id, c.number", ", lines AS (SELECT c.clip_id, c.number", 1) + ") SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY live DESC, number, team) AS INT) AS rank, number, team, live AS frames FROM lines")
def t3_ordered_lines(t, o, r, labels, rosters):
    run = box.identify(t, o, r, labels, rosters, _FPS)
    return reports.ordered_lines(identity.box_score(run.events, run.registry, o, 1.0, rosters=rosters)).select("clip_id", "rank", "number", "team", F.col("seconds_total").cast("long").alias("frames"))


@query("i5_flagship_queue", *_ALL)
def i5_flagship_queue(t, o, r, labels, rosters):
    """The review queue of the flagship's run."""
    return seeding.review_items(box.identify(t, o, r, labels, rosters, _FPS).events)


@query("w9_reattach_verdicts", "tracks", "crops", sql=""", m AS (SELECT clip_id, CAST(CASE WHEN c1 > 100 THEN 2 ELSE track_id % 2 END AS BIGINT) AS team, avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2 FROM crops GROUP BY ALL),
d AS (SELECT c.clip_id, c.frame, c.track_id, m.team, sqrt((c0-m0)*(c0-m0) + (c1-m1)*(c1-m1) + (c2-m2)*(c2-m2)) AS d FROM crops c JOIN m ON m.clip_id = c.clip_id),
v AS (SELECT clip_id, frame, track_id, CASE WHEN list(d ORDER BY d)[2] >= 1.4 * greatest(list(d ORDER BY d)[1], 1e-6) THEN list(team ORDER BY d)[1] END AS team FROM d GROUP BY ALL)
SELECT g.clip_id, g.track_id, g.frame, gap, b.team AS before, a.team AS after, CASE WHEN b.team IS NULL OR a.team IS NULL THEN 'abstain' WHEN b.team = a.team THEN 'safe' ELSE 'suspect' END AS verdict
 FROM (SELECT * FROM (SELECT clip_id, track_id, frame, frame - lag(frame) OVER (PARTITION BY clip_id, track_id ORDER BY frame) - 1 AS gap FROM tracks) WHERE gap >= 3) g LEFT JOIN v a ON a.clip_id = g.clip_id AND a.frame = g.frame AND a.track_id = g.track_id LEFT JOIN v b ON b.clip_id = g.clip_id AND b.frame = g.frame - gap - 1 AND b.track_id = g.track_id""")
def w9_reattach_verdicts(t, c):
    hinted = c.withColumn("team_hint", F.when(F.col("c1") > 100, 2).otherwise(F.col("track_id") % 2))
    return quality.reattach_verdicts(quality.reattach_gaps(t), c, colors.centroids(hinted))


@query("a28_worst_identities", "tracks", sql=f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY frames DESC, "window", identity_id) AS INT) AS rank FROM (
 SELECT clip_id, "window", identity_id, count(*) AS frames, count(DISTINCT track_id) AS tracks, count(DISTINCT number) AS numbers FROM (SELECT clip_id, {_W}, track_id % 6 AS identity_id, track_id, CASE WHEN track_id % 4 <> 3 THEN track_id * 7 % 50 END AS number FROM tracks) GROUP BY ALL HAVING count(DISTINCT number) > 1)) WHERE rank <= 5""")
def a28_worst_identities(t):
    events = t.select("clip_id", team.fixed_window(), "frame", "track_id", (F.col("track_id") % 6).alias("identity_id"))
    labels = t.where("track_id % 4 <> 3").select("clip_id", "track_id", (F.col("track_id") * 7 % 50).alias("number")).distinct()
    return audit.worst_identities(events, labels)


@query("j12_outside_span", "shots", "ball", sql="SELECT s.clip_id, s.shot_id FROM shots s LEFT JOIN (SELECT clip_id, min(frame) AS a, max(frame) AS b FROM ball WHERE frame BETWEEN 40 AND 200 AND clip_id % 3 <> 2 GROUP BY ALL) e USING (clip_id) WHERE a IS NULL OR start_frame < a OR start_frame > b")
def j12_outside_span(s, b):
    """Against events of a narrower span than the shots', which some clips lack."""
    return shots.outside_span(s, b.where("frame between 40 and 200 and clip_id % 3 <> 2")).select("clip_id", "shot_id")


@query("a32_harvest_frames", "tracks", "shots", sql="SELECT clip_id, frame FROM (SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, frame) AS r FROM tracks GROUP BY clip_id, frame) WHERE r <= 60 UNION SELECT clip_id, unnest(range(start_frame, end_frame + 1)) FROM shots")
def a32_harvest_frames(t, s):
    return quality.harvest_frames(t, s)
