"""Shots and audits: order of reasons, bounds of intervals, nulls and ties."""

from pyspark.sql import functions as F

from courtflow.operators import audit, shots

SHOT = "clip_id long, shot_id long, start_frame long, end_frame long, hoop string, track_id long"


def test_shooters_take_the_last_event_and_give_reasons(spark):
    s = spark.createDataFrame([(0, 1, 10, 20, "far", 4), (0, 2, 10, 20, "far", None), (0, 3, 11, 20, "far", 4), (0, 4, 12, 22, "near", 6)], SHOT)
    e = spark.createDataFrame([(0, 10, 4, 1, 40, "confirmed"), (0, 10, 4, 2, 41, "candidate"), (0, 12, 6, 3, 60, "confirmed")], "clip_id long, frame long, track_id long, event_ord long, identity_id long, state string")
    got = {r.shot_id: (r.status, r.identity_id) for r in shots.shooters(s, e).collect()}
    assert got == {1: ("review_item", 41), 2: ("no_confident_shooter", None), 3: ("no_identity_data", None), 4: ("attributed", 60)}


def test_score_windows(spark):
    s = spark.createDataFrame([(0, 1, 0, 10, "far", 1), (0, 2, 40, 50, "far", 1), (1, 3, 0, 5, "far", 1)], SHOT)
    c = spark.createDataFrame([(0, 1, 40), (0, 2, 50), (0, 3, 230), (1, 4, 4)], "clip_id long, score_id long, frame long")
    assert {r.shot_id: r.score_frame for r in shots.first_change(s, c).collect()} == {1: None, 2: 50, 3: None}
    assert {r.shot_id: r.changes for r in shots.made_nearby(s, c, 30).collect()} == {1: 1, 2: 1, 3: 0}


def test_falls_need_three_falling_points(spark):
    s = spark.createDataFrame([(0, 1, 0, 10, "far", 1), (0, 2, 0, 30, "far", 1)], SHOT)
    dets = spark.createDataFrame([(0, 11, 0, 100.0, 210.0, 0.5), (0, 12, 0, 100.0, 206.0, 0.5), (0, 13, 0, 100.0, 260.0, 0.5), (0, 31, 0, 100.0, 300.0, 0.5), (0, 32, 0, 100.0, 250.0, 0.5), (0, 33, 0, 100.0, 310.0, 0.5)], "clip_id long, frame long, det_idx long, cx double, cy double, conf double")
    hoops = spark.range(60).select(F.lit(0).cast("long").alias("clip_id"), F.col("id").alias("frame"), F.lit("far").alias("hoop"), F.lit(110.0).alias("hx"), F.lit(200.0).alias("hy"))
    assert [(r.shot_id, r.points) for r in shots.falls_below_rim(s, dets, hoops).collect()] == [(1, 3)]


def test_scoreboard_abstains(spark):
    d = spark.createDataFrame([(0, 1, 0, 90.0, 30.0, 7, 0.9), (0, 1, 1, 10.0, 28.0, 5, 0.2), (0, 1, 2, 50.0, 9.0, 3, 0.9), (0, 2, 3, 10.0, 28.0, 5, 0.9), (0, 3, 4, 90.0, 30.0, 7, 0.1), (0, 3, 5, 10.0, 28.0, 5, 0.9)], "clip_id long, frame long, det_idx long, cx double, h double, value long, conf double")
    assert {r.frame: (r.home, r.away) for r in audit.scoreboard(d).collect()} == {1: (5, 7), 2: (None, None), 3: (None, None)}


def test_overlaps_and_empty_tables(spark):
    kind = "clip_id long, window long, identity_id long, number long, frame long"
    a = spark.createDataFrame([(0, 0, 1, 7, f) for f in range(15)], kind)
    got = audit.overlaps(a, a.where("frame >= 2")).first()
    assert got.frames == 13 and got.first_frames == list(range(2, 12))
    assert audit.overlaps(a, a.limit(0)).count() == 0
    assert shots.first_change(spark.createDataFrame([], SHOT), spark.createDataFrame([], "clip_id long, score_id long, frame long")).count() == 0
