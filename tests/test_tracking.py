"""Operators on literal rows, and every SQL query against DuckDB on the smallest tables."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from courtflow import queries
from courtflow.operators import ball, colors, identity, quality, team
from courtflow.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    told = con.sql(f"select * from ({queries.ORACLE_SQL[name]})")
    assert sorted(told.columns) == cols
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, f, t, t, float(x), 0.0, x + 10.0, 20.0) for f, t, x in rows], "clip_id long, window long, frame long, track_id long, track_pos long, x1 double, y1 double, x2 double, y2 double")


def test_identity_relink_is_only_a_candidate(spark):
    rows = [(f, 9, 0) for f in range(12)] + [(f, 1, 0) for f in (0, 1, 2, 6, 7)]
    seeds = spark.createDataFrame([(1, 0, 1)], "clip_id long, window long, track_id long")
    got = {(r.track_id, r.frame): r.state for r in identity.identity_runs(boxes(spark, rows), seeds).collect()}
    assert got[1, 2] == "confirmed" and got[1, 6] == got[1, 7] == "candidate" and got[9, 11] == "unknown"


def test_identity_far_return_is_new(spark):
    rows = [(f, 9, 0) for f in range(12)] + [(0, 1, 0), (1, 1, 0), (5, 1, 900)]
    ids = identity.with_identity_ids(identity.identity_runs(boxes(spark, rows))).where("track_id = 1").collect()
    assert len({r.identity_id for r in ids}) == 2 and {r.state for r in ids} == {"unknown"}


def test_vote_tie_is_off(spark):
    rows = spark.createDataFrame([(1, 0, 5, True), (1, 0, 5, False)], "clip_id long, window long, track_id long, is_on boolean")
    assert identity.on_court_vote(rows).first().on_court is False


def test_short_possession_merges(spark):
    rows = [(1, f, 20.0 if f < 200 or 260 <= f < 500 else 70.0) for f in range(700)]
    got = team.possessions_v2(spark.createDataFrame(rows, "clip_id long, frame long, mean_x double")).orderBy("start").collect()
    assert [(r.side, r.start, r.end) for r in got] == [("left", 0, 499), ("right", 500, 699)]


def test_a_parabola_is_one_arc(spark):
    rows = [(1, f, 0, 100.0 + 8 * f, 200.0 + 0.5 * (f - 12) ** 2, 0.9) for f in range(25) if f != 11]
    points = ball.chain_points(spark.createDataFrame(rows, "clip_id long, frame long, det_idx long, cx double, cy double, conf double"))
    arcs = ball.arcs(points)
    assert [(r.start_frame, r.end_frame, r.n_points) for r in arcs.collect()] == [(0, 24, 24)]
    hoops = spark.createDataFrame([(1, f, "far", 292.0, 272.0) for f in range(30)], "clip_id long, frame long, hoop string, hx double, hy double")
    shot = ball.shot_attempts(arcs, points, hoops).first()
    assert (shot.verdict, shot.shot_type, shot.arrival) == ("shot_attempt", "layup", "observed") or shot.shot_type == "jumpshot"


def test_glare_claims_nothing(spark):
    rows = [(1, f, 0, 100.0 + 0.1 * f, 200.0, 0.9) for f in range(20)]
    points = ball.chain_points(spark.createDataFrame(rows, "clip_id long, frame long, det_idx long, cx double, cy double, conf double"))
    assert ball.chain_verdicts(points, ball.arcs(points)).first().verdict == "static_junk"


def test_score_must_not_fall(spark):
    rows = [(1, f, h, 0) for f, h in enumerate([2] * 7 + [4] * 7 + [1] * 7 + [6] * 7)]
    got = quality.debounced_scores(spark.createDataFrame(rows, "clip_id long, frame long, home long, away long")).collect()
    assert [(r.from_home, r.to_home) for r in got] == [(2, 4), (4, 6)]


def test_majority_abstains_on_ties(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "clip_id long, team string")
    assert {r.clip_id: r.team for r in colors.majority(rows, ["clip_id"]).collect()} == {1: None, 2: "a", 3: None}


def test_empty_frames_keep_a_row(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"clip": "A", "frames": [{"frame_index": 3, "tracks": []}, {"frame_index": 4, "tracks": [{"track_id": 7, "bbox": [1, 2, 3, 4]}]}]}))
    got = readers.read_tracks(spark, str(tmp_path / "t.json")).orderBy("frame").collect()
    assert [(r.frame, r.track_id, r.y2) for r in got] == [(3, None, None), (4, 7, 4.0)]
