"""Camera motion, touches, courts, crops, documents and bundles against plain loops and literal rows."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflow import capture_queries, queries
from courtflow.functions import exprs as X
from courtflow.operators import audit, ball, camera, courts, crops, identity, touches
from courtflow.plans import box, stats
from courtflow.sources import adapters, documents, readers
from courtflow.streaming import presence

SF = "/root/testdata/sf0.001"


def nine(m):
    return [float(x) for x in np.asarray(m).ravel()]


def test_cumulative_transforms_equal_plain_products(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for clip in ("a", "b"):
        now, lost = np.eye(3), 0
        h0 = np.array([[2.0, 0.1, 5], [0, 3, 1], [1e-4, 0, 1]])
        for i, f in enumerate(range(5, 400, 2)):
            g = np.eye(3) + rng.normal(0, 0.01, (3, 3)) * [[1, 1, 100], [1, 1, 100], [1e-3, 1e-3, 0]]
            kind = rng.integers(0, 12)
            g = g * [[3], [3], [1]] if kind == 0 else g
            if kind == 1:
                g[0, 2] = math.inf
            rows.append((clip, f, None if kind == 2 else nine(g)))
            if i:
                if kind in (0, 1, 2):
                    lost += 1
                else:
                    now = now @ g
            h = h0 @ now
            want[clip, f] = (now, bool(i) and kind in (0, 1, 2), lost, h / h[2, 2] if clip == "a" else None)
    steps = spark.createDataFrame(rows, "clip_id string, frame long, g array<double>")
    anchors = spark.createDataFrame([("a", nine([[2.0, 0.1, 5], [0, 3, 1], [1e-4, 0, 1]]))], "clip_id string, h0 array<double>")
    got = camera.cumulative_transforms(steps, anchors, block=50).collect()
    assert len(got) == len(want)
    for r in got:
        a, held, lost, h = want[r.clip_id, r.frame]
        assert np.allclose(np.reshape(r.a, (3, 3)), a, rtol=1e-9, atol=1e-9) and (r.held, r.lost) == (held, lost)
        assert r.h is None if h is None else np.allclose(np.reshape(r.h, (3, 3)), h, rtol=1e-9, atol=1e-9)
    assert camera.cumulative_transforms(steps.limit(0)).count() == 0


def test_keyframe_chain_breaks_at_a_failed_hop(spark):
    rng = np.random.default_rng(2)
    hop = [np.eye(3) + rng.normal(0, 0.05, (3, 3)) * [[1, 1, 50], [1, 1, 50], [1e-4, 1e-4, 0]] for _ in range(5)]
    rows = [(1, i, None if i in (0, 4) else nine(hop[i])) for i in range(5)] + [(1, 5, None)]
    got = {r.pos: r.h for r in camera.keyframe_chain(spark.createDataFrame(rows, "clip_id long, pos long, fwd array<double>"), spark.createDataFrame([(1, 2)], "clip_id long, ref_pos long")).collect()}
    unit = lambda m: m / m[2, 2]
    assert got[0] is None and got[5] is None and np.allclose(np.reshape(got[2], (3, 3)), np.eye(3))
    assert np.allclose(np.reshape(got[1], (3, 3)), unit(hop[1])) and np.allclose(np.reshape(got[4], (3, 3)), unit(unit(np.linalg.inv(hop[2])) @ np.linalg.inv(hop[3])))


def test_compose_and_inverse(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (2, 3, 3)) + 2 * np.eye(3)
    row = spark.createDataFrame([(nine(a), nine(b), nine(np.zeros((3, 3))))], "a array<double>, b array<double>, z array<double>")
    at = lambda c: [F.get(c, F.lit(i)) for i in range(9)]
    r = row.select(F.array(*X.compose(at("a"), at("b"))).alias("ab"), F.array(*X.inverse(at("a"))).alias("inv"), F.array(*X.inverse(at("z"))).alias("none")).first()
    assert np.allclose(np.reshape(r.ab, (3, 3)), a @ b / (a @ b)[2, 2]) and np.allclose(np.reshape(r.inv, (3, 3)), np.linalg.inv(a)) and r.none == [None] * 9


def test_hoops_are_carried_or_refused(spark):
    k = spark.createDataFrame([(1, 0, nine(np.eye(3))), (1, 9, nine(np.diag([2.0, 2, 1])))], "clip_id long, keyframe long, k array<double>")
    far = nine([[1e-4, 0, 0], [0, 1, 0], [0, 0, 1]])
    rows = [(1, 0, 0, nine([[1, 0, 10], [0, 1, 0], [0, 0, 1]])), (1, 1, 9, nine(np.eye(3))), (1, 2, 0, far), (1, 3, 0, nine(np.zeros((3, 3))))]
    matches = spark.createDataFrame(rows, "clip_id long, frame long, keyframe long, m array<double>")
    frames = spark.createDataFrame([(1, f) for f in range(5)], "clip_id long, frame long")
    anchors = spark.createDataFrame([(1, "far", 0, 900.0, 500.0)], "clip_id long, hoop string, keyframe long, px double, py double")
    got = {r.frame: (r.hx, r.hy, r.status) for r in camera.carried_hoops(frames, matches, k, anchors, spark.createDataFrame([(1, 1920, 1080)], "clip_id long, width int, height int")).collect()}
    assert got == {0: (890.0, 500.0, "carried"), 1: (450.0, 250.0, "carried"), 2: (None, None, "implausible"), 3: (None, None, "degenerate"), 4: (None, None, "no match")}


def test_touches_need_reach_margin_and_length(spark):
    """Body 1 stands at x 0..20 (height 100), body 2 at 200..220, referee 9 where body 1 is."""
    held = [(f, 10.0) for f in range(5)] + [(f, 40.0) for f in range(13, 16)] + [(30 + f, 210.0) for f in range(5)] + [(50 + f, 25.0) for f in range(6)] + [(60, 100.0), (61, 110.0)]
    dets = spark.createDataFrame([(1, f, 0, x, 50.0, 0.9) for f, x in held] + [(1, 2, 1, 210.0, 50.0, 0.5), (1, 62, 0, 10.0, 50.0, 0.05)], "clip_id long, frame long, det_idx long, cx double, cy double, conf double")
    tracks = spark.createDataFrame([(1, f, t, x, 0.0, x + 20, 100.0) for f in range(70) for t, x in ((1, 0.0), (2, 200.0), (9, 0.0))] + [(1, 55, 3, 30.0, 0.0, 50.0, 100.0)], "clip_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    holders = touches.frame_holders(tracks.select("clip_id", "frame"), tracks, dets, spark.createDataFrame([(1, 9)], "clip_id long, track_id long"))
    at = {r.frame: (r.verdict, r.track_id) for r in holders.collect()}
    assert at[0] == ("held", 1) and at[13] == ("held", 1) and at[30] == ("held", 2) and at[55] == ("contested", None) and at[60] == ("too_far", None) and at[62] == ("no_ball", None) and len(at) == 70
    got = touches.touches(holders, 10.0).collect()
    assert [(r.track_id, r.start_frame, r.end_frame, r.held_frames, r.observed_seconds, r.inferred_seconds) for r in got] == [(1, 0, 15, 8, 0.8, 0.8)]
    events = spark.createDataFrame([(1, 0, f, 1, 5, "candidate", None if f == 0 else 23) for f in (0, 1, 2)], "clip_id long, window long, frame long, track_id long, identity_id long, state string, number long")
    places = spark.createDataFrame([(1, 0, 1, 6.7, 25.7), (1, 15, 1, 5.9, 27.5)], "clip_id long, frame long, track_id long, court_x double, court_y double")
    told = touches.attributed_touches(touches.touches(holders, 10.0), holders, events, places)
    r = told.first()
    assert (r.number, r.identities, r.states, r.frames_with_identity, r.status, r.court_x, r.end_y) == (23, 1, {"candidate": 3}, 3, "review_item", 6.7, 27.5)
    s = touches.touch_summary(told).first()
    assert (s.n_touches, s.n_nameable, s.pct_inferred, s.paint, s.three) == (1, 1, 50.0, 1, 0)


def marks_of(spark, court, keyframes, tags=None, noise=0.5, swap=None):
    rng = np.random.default_rng(7)
    table = courts.court_table(spark, capture_queries.COURTS)
    places = {r.tag: (r.court_x, r.court_y) for r in courts.court_tags(table.where(F.col("court") == capture_queries.COURTS[court][0])).collect()}
    rows = []
    for k in keyframes:
        h = np.array([[9 + k % 3, 2, 100], [0.3, -8, 700], [1e-4, 3e-3, 1]])
        for tag in tags or sorted(places)[:: 1 + k % 2]:
            x, y, w = h @ [*places[tag], 1]
            rows.append((1, k, (swap or {}).get(tag, tag), float(x / w + rng.normal(0, noise)), float(y / w + rng.normal(0, noise))))
    return courts.identified_courts(courts.court_errors(spark.createDataFrame(rows, "clip_id long, keyframe long, tag string, px double, py double"), table)).first()


def test_courts_are_named_only_if_clearly_best(spark):
    for court in (0, 1, 3):
        r = marks_of(spark, court, range(4))
        assert r.identified and r.court == capture_queries.COURTS[court][0] and r.margin >= 1.35 and r.reason is None
    key = ["LB_side_far", "L_lane_base_near", "L_lane_base_far", "L_FT_near", "L_FT_far"]
    r = marks_of(spark, 1, range(3), key)
    assert not r.identified and "too close to call" in r.reason
    r = marks_of(spark, 1, range(2), swap={"R_FT_near": "R_FT_far", "R_FT_far": "R_FT_near"})
    assert not r.identified and "no known court fits" in r.reason and r.margin is None
    r = marks_of(spark, 1, range(3), key[:4])
    assert not r.identified and "marks" in r.reason and (r.marks, r.frames) == (0, 0)


def test_court_marks_move_with_the_floor(spark):
    at = {(r.court[:2], r.tag): (r.court_x, r.court_y) for r in courts.court_tags(courts.court_table(spark, capture_queries.COURTS[:2])).collect()}
    assert len(at) == 42 and at["84", "center_logo"] == (42.0, 25.0) and at["94", "center_logo"] == (47.0, 25.0) and at["94", "R_lane_base_near"][0] == 94.0
    assert at["84", "L_arc_top"] == at["94", "L_arc_top"] == (25.0, 25.0) and at["84", "R_arc_top"][0] == 59.0 and at["94", "R_arc_top"][0] == 69.0


def test_homographies_at_once_equal_each_alone():
    """Sets that converge at different steps, one that determines no transform and one of equal points don't disturb each other."""
    rng = np.random.default_rng(11)
    src, dst = rng.uniform(0, 1000, (40, 7, 2)), rng.uniform(0, 90, (40, 7, 2))
    for i in range(20):  # half of them exact up to noise of several sizes, the others fit nothing
        h = np.array([[0.1, 0.01, 3], [0.02, -0.09, 60], [1e-5, 4e-4 + i * 1e-5, 1]])
        q = np.column_stack((src[i], np.ones(7))) @ h.T
        dst[i] = q[:, :2] / q[:, 2:] + rng.normal(0, 10.0 ** -(i % 5), (7, 2))
    src[30], src[31] = np.column_stack((np.arange(7.0), np.arange(7.0))), 5.0
    got = courts.homographies(src, dst)
    assert np.isnan(got[30:32]).all() and np.isfinite(got[:30]).all()
    for i in range(40):
        alone = courts.homography(src[i], dst[i])
        assert (alone is None) == (i in (30, 31)) and (alone is None or np.allclose(alone / np.abs(alone).max(), got[i] / np.abs(got[i]).max(), rtol=1e-6, atol=1e-9))


def test_court_fits_are_made_many_at_a_time(spark):
    """A call a keyframe cost more than its fits; sets of different sizes share a batch, and each keeps its own error."""
    table = courts.court_table(spark, capture_queries.COURTS)
    places = courts.court_tags(table.where(F.col("court") == capture_queries.COURTS[1][0])).orderBy("tag").collect()
    rows = [(c, k, p.tag, 9 * p.court_x + c * (i % 2), 700 - 8 * p.court_y) for c in (0, 1) for k in range(12) for i, p in enumerate(places[: 4 + k])]
    made = courts.court_errors(spark.createDataFrame(rows, "clip_id long, keyframe long, tag string, px double, py double"), table)
    assert "GroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.clip_id, r.court): r for r in made.collect()}
    assert {(r.marks, r.frames) for r in got.values()} == {(sum(range(5, 16)), 11)} and len(got) == 8
    assert got[0, capture_queries.COURTS[1][0]].error_ft < 1e-9 and got[1, capture_queries.COURTS[1][0]].error_ft > 1e-3


def test_homography_is_the_least_squares_one():
    """No small change of the fit leaves less distance."""
    rng = np.random.default_rng(5)
    src, true = rng.uniform(0, 1000, (9, 2)), np.array([[0.1, 0.01, 3], [0.02, -0.09, 60], [1e-5, 4e-4, 1]])
    away = lambda h, p: ((np.column_stack((p, np.ones(len(p)))) @ h.T)[:, :2] / (np.column_stack((p, np.ones(len(p)))) @ h.T)[:, 2:])
    dst = away(true, src) + rng.normal(0, 0.3, (9, 2))
    h = courts.homography(src, dst)
    h = h / h[2, 2]
    best = ((away(h, src) - dst) ** 2).sum()
    for i in range(8):
        for s in (-1e-5, 1e-5):
            m = h.copy()
            m[i // 3, i % 3] *= 1 + s
            assert ((away(m, src) - dst) ** 2).sum() >= best * (1 - 1e-9)
    assert courts.homography(np.column_stack((np.arange(6.0), np.arange(6.0))), dst[:6]) is None


def spaced(rows, spacing, cap):
    out = []
    for f, h in rows:
        if len(out) < cap and all(abs(f - g) >= spacing for g, _ in out):
            out.append((f, h))
    return out


def test_crops_equal_plain_greedy_loops(spark):
    rng = random.Random(3)
    boxes = {t: sorted((f, float(rng.choice([50, 70, 90, 95, 100, 120]))) for f in rng.sample(range(300), rng.randint(1, 150))) for t in range(30)}
    rows = spark.createDataFrame([(1, t, f, 0.0, h) for t, b in boxes.items() for f, h in b], "clip_id long, track_id long, frame long, y1 double, y2 double")
    read = lambda df: {t: [(r.frame, r.h) for r in sorted(df.collect(), key=lambda r: r.pick) if r.track_id == t] for t in boxes}
    tallest = lambda part: max(part, key=lambda b: (b[1], -b[0]))
    w11, w12, w13 = {}, {}, {}
    for t, b in boxes.items():
        big = [x for x in b if x[1] >= 90]
        k = max(1, len(big) // 6)
        w11[t] = spaced([tallest(big[i : i + k]) for i in range(0, len(big), k)], 3, 12)
        mid = [x for x in b if x[1] >= 60]
        k = max(1, len(mid) // 6)
        parts = [mid[i * k : (i + 1) * k] if i < 5 else mid[i * k :] for i in range(6)]
        w12[t] = spaced([tallest(p) for p in parts if p], 5, 99)
        w13[t] = spaced(sorted(big, key=lambda x: -x[1]), 2, 10)
    assert read(crops.purity_crops(rows)) == w11
    assert read(crops.review_crops(rows, ["clip_id", "track_id"])) == w12
    assert read(crops.largest_spaced(rows, ["clip_id", "track_id"])) == w13


def test_relink_audit_equals_two_plain_machines(spark):
    from tests.test_identity import plain_machine

    t, o = adapters.load(spark, SF, "tracks"), adapters.load(spark, SF, "oncourt")
    starts = spark.createDataFrame([(0, s) for s in range(0, 250, 20)], "clip_id long, start long")
    (r,) = box.relink_audit(t, starts).collect()
    rows = [(x.clip_id, 0, x.frame, x.track_id, x.track_pos, (x.x1 + x.x2) / 2, (x.y1 + x.y2) / 2) for x in t.collect()]
    free = plain_machine(rows, set())
    kept = plain_machine([(x[0], x[2] // 20, *x[2:]) for x in rows], set())

    def crossings(told, window):
        last, n = {}, 0
        for (c, _, f, k), (run, state) in sorted(told.items(), key=lambda i: (i[0][0], i[0][3], i[0][2])):
            at = (c, k, window(f), run)
            if at in last and state == "candidate" and last[at][0] < f - 1 and last[at][0] // 20 != f // 20:
                n += 1
            last[at] = (f, state)
        return n

    assert r.leaks == 0 and r.relinks > 0 and o.count() > 0
    assert r.cut == crossings(free, lambda f: 0) and crossings(kept, lambda f: f // 20) == 0


# -- documents ---------------------------------------------------------------------------------------------------------------------


def one_file(tmp_path, doc, name="d.json"):
    (tmp_path / name).write_text(json.dumps(doc, indent=1))
    return str(tmp_path / name)


def again(spark, tmp_path, docs, schema):
    documents.write_documents(docs, str(tmp_path / "out"))
    return documents.read_documents(spark, str(tmp_path / "out"), schema, lines=True)


def test_team_events_round_trip_with_defaults(spark, tmp_path):
    sure = {"inliers": 88, "reproj_px": 1.5, "state": "ok", "nearest_keyframe": 240}
    doc = {"clip": "T", "fps": 30.0, "frames": [{"frame_index": 3, "timestamp_s": 0.1, "homography_confidence": sure, "detections": [{"pixel": [1, 2], "court_feet": [3, 4]}, {"pixel": [5, 6], "court_feet": [7, 8], "team": "a", "identity_state": "unknown"}]}, {"frame_index": 4, "timestamp_s": 0.133, "homography_confidence": sure, "detections": []}]}
    rows = documents.team_events(documents.read_documents(spark, one_file(tmp_path, doc), documents.TEAM_EVENTS))
    assert [(r.frame, r.det_idx, r.court_y, r.team, r.confidence) for r in rows.orderBy("frame", "det_idx").collect()] == [(3, 0, 4.0, "unknown", "ok"), (3, 1, 8.0, "a", "ok"), (4, None, None, None, "ok")]
    back = again(spark, tmp_path, documents.team_event_documents(rows), documents.TEAM_EVENTS)
    assert readers.same_rows(documents.team_events(back), rows) and back.first().schema_version == "team_event.v1"


def test_outcomes_resolutions_and_purity_round_trip(spark, tmp_path):
    agree = {"window": 0, "identity_id": 5, "track_id": 105, "position_hypothesis": 13, "final_state": "confirmed", "read_number": 13, "read_confidence": 0.99, "read_frame": 10}
    doc = {"clip": "T", "window_boundaries": [0, 60], "outcomes": {"agree": [agree], "disagree": [], "no_confident_read": [agree | {"identity_id": 6, "read_number": None}]}, "identities": [{"window": 0, "identity_id": i, "track_id": 100 + i, "roster_number": None, "final_state": "unknown"} for i in (5, 6)]}
    docs = documents.read_documents(spark, one_file(tmp_path, doc), documents.OUTCOMES)
    told, known = documents.outcome_rows(docs), documents.identity_rows(docs)
    assert sorted((r.outcome, r.identity_id, r.read_number) for r in told.collect()) == [("agree", 5, 13), ("no_confident_read", 6, None)] and known.count() == 2
    starts = spark.createDataFrame([("T", 60), ("T", 0)], "clip_id string, start long")
    back = again(spark, tmp_path, documents.outcome_documents(told, known, starts), documents.OUTCOMES)
    assert readers.same_rows(documents.outcome_rows(back), told) and readers.same_rows(documents.identity_rows(back), known) and back.first().window_boundaries == [0, 60]
    res = documents.resolution_rows(documents.read_documents(spark, one_file(tmp_path, {"clip": "T", "window_boundaries": [0, 60], "queue_resolutions": [{"window": 0, "identity_id": 3, "track_id": 17, "number": 13}, {"window": 1, "identity_id": 4, "number": "reject", "needs_review": "moved"}]}), documents.RESOLUTIONS))
    assert [(r.ord, r.track_id, r.number, r.needs_review, r.made_against) for r in res.orderBy("ord").collect()] == [(0, 17, "13", None, [0, 60]), (1, None, "reject", "moved", [0, 60])]
    pure = documents.purity_rows(documents.read_documents(spark, one_file(tmp_path, {"clip": "T", "tracks": {"49": {"verdict": "spliced", "attempts": 9, "interleaved": False, "splice_interval": [3, 8]}, "5": {"verdict": "consistent", "attempts": 2}}}), documents.PURITY))
    assert sorted((r.track_id, r.verdict, r.splice_to) for r in pure.collect()) == [(5, "consistent", None), (49, "spliced", 8)]
    assert readers.same_rows(documents.purity_rows(again(spark, tmp_path, documents.purity_documents(pure), documents.PURITY)), pure)


def test_config_landmarks_scoreboard_possessions_and_arcs(spark, tmp_path):
    conf = {"name": "T", "tracking_span_start": 120, "tracking_span_len": 461, "teams": [{"name": "a", "color": "red", "numbers": [5, 13]}, {"name": "b", "color": "white", "numbers": [13]}], "hoop_anchors": {"far": {"keyframe": 240, "pixel": [850, 120]}}}
    clips, rosters, anchors = documents.config_rows(documents.read_documents(spark, one_file(tmp_path, conf), documents.CONFIG))
    assert clips.first().tracking_span_len == 461 and {r.number for r in identity.dual_numbers(rosters).collect()} == {13} and anchors.first().px == 850.0
    marks = documents.landmark_rows(documents.read_documents(spark, one_file(tmp_path, {"clip": "T", "landmarks": {"240": [{"tag": "center_logo", "x": 1, "y": 2}]}}), documents.LANDMARKS))
    assert tuple(marks.first()) == ("T", 240, "center_logo", 1.0, 2.0)
    seen = spark.createDataFrame([("T", 3, 0, 0), ("T", 1, None, 2)], "clip_id string, frame long, home long, away long")
    none = spark.createDataFrame([], "clip_id string, frame long, from_home long, from_away long, to_home long, to_away long")
    reads, events = documents.scoreboard_rows(again(spark, tmp_path, documents.scoreboard_documents(seen, none, 15), documents.SCOREBOARD))
    assert readers.same_rows(reads, seen) and events.count() == 0
    held = spark.createDataFrame([("T", "left", 0, 50, 0.9), ("T", "right", 51, 99, 1.0)], "clip_id string, side string, start long, `end` long, side_agreement double")
    back = again(spark, tmp_path, documents.possession_documents(held, spark.createDataFrame([("T", 0), ("T", 51)], "clip_id string, start long")), documents.POSSESSIONS)
    assert readers.same_rows(documents.possession_rows(back), held) and back.first().boundaries == [0, 51]
    arcs = {"clip": "T", "chains": [{"points": [[1, 2.5, 3], [2, 4, 5]], "verdict": "too_short", "arcs": []}, {"points": [[9, 1, 1]], "verdict": "arc", "arcs": [{"start_frame": 9, "end_frame": 20, "n_points": 12}]}]}
    points, found = documents.arc_rows(documents.read_documents(spark, one_file(tmp_path, arcs), documents.ARCS))
    assert points.count() == 3 and sorted((r.chain, r.verdict, r.start_frame) for r in found.collect()) == [(0, "too_short", None), (1, "arc", 9)]


def test_event_tables_and_other_readers(spark, tmp_path):
    events = spark.createDataFrame([("07", 0, 1, 4, 4, "confirmed"), ("b", 1, 70, 5, 5, "unknown")], "clip_id string, window long, frame long, identity_id long, track_id long, state string")
    documents.write_events(events, str(tmp_path / "events"))
    assert readers.same_rows(documents.read_events(spark, str(tmp_path / "events")).select(*events.columns), events)
    on = readers.read_oncourt(spark, one_file(tmp_path, {"clip": "T", "frames": [{"frame_index": 1, "tracks": {"4": {"on": True, "court_feet": [3, 4]}}}, {"frame_index": 2, "tracks": {}}]}))
    assert [tuple(r) for r in on.collect()] == [("T", 1, 4, True, 3.0, 4.0)]
    dets = readers.read_ball(spark, one_file(tmp_path, {"clip": "T", "frames": [{"frame_index": 1, "detections": [{"bbox": [0, 0, 10, 20], "conf": 0.5}]}]}))
    assert [tuple(r) for r in dets.collect()] == [("T", 1, 0, 5.0, 10.0, 0.5)]
    hoops = readers.read_hoops(spark, one_file(tmp_path, {"clip": "T", "frames": [{"frame_index": 1, "hoop_far_px": [1, 2], "hoop_near_px": None}]}))
    assert [tuple(r) for r in hoops.collect()] == [("T", 1, "far", 1.0, 2.0)]
    lines = spark.createDataFrame([(1, 13, 1.5, {"PAINT": 1.5})], "clip_id long, number long, seconds_total double, zone_seconds map<string,double>")
    readers.write_box_score(lines, str(tmp_path / "box"))
    row = spark.read.option("header", True).csv(str(tmp_path / "box" / "csv")).first()
    assert row.seconds_total == "1.50" and json.loads(row.zone_seconds) == {"PAINT": 1.5} and spark.read.json(str(tmp_path / "box" / "json")).first().number == 13


def test_bundle_of_a_clip(spark, tmp_path):
    lines = spark.createDataFrame([(1, 23, "home", 15.0, 15.0, 0.0, 2, {"PAINT": 15.0}, "PAINT", 0.0), (1, 7, "AMBIGUOUS (a / b)", 20.0, 10.0, 10.0, 1, {}, None, 0.0)], "clip_id long, number long, team string, seconds_total double, seconds_live double, seconds_retro double, windows_present int, zone_seconds map<string,double>, top_zone string, disputed_seconds double")
    summary = spark.createDataFrame([(1, 2, 2.8, 1904, 7983, 50.0), (2, 0, 0.0, 0, 0, 0.0)], "clip_id long, unnamed_identities long, unnamed_seconds double, candidate_events long, unknown_events long, readable_seconds double")
    places = spark.createDataFrame([(1, 164, 184, "located", 6.7, 27.5, "review_item"), (1, 10, 20, "located", 50.0, 25.0, None), (1, 30, 40, "off_court", None, None, None)], "clip_id long, start_frame long, end_frame long, status string, court_x double, court_y double, shooter_status string")
    tries = spark.createDataFrame([(1, 164, 184, "shot_attempt", "layup", "far"), (1, 10, 20, "deflection", "jumpshot", "far")], "clip_id long, start_frame long, end_frame long, verdict string, shot_type string, hoop string")
    made = stats.measured_stats(lines, summary, places, tries)
    docs = {r.clip_id: r.doc.asDict(True) for r in made.collect()}
    d = docs[1]
    assert d["tracking"]["pct_of_readable_named"] == 70.0 and d["tracking"]["named_seconds"] == 35.0 and docs[2]["tracking"]["pct_of_readable_named"] is None
    assert [(b["number"], b["ambiguous"]) for b in d["box_score"]] == [(7, True), (23, False)] and d["shots_unlocated"] == 1
    assert [(s["start_frame"], s["zone"], s["dist_ft"], s["shot_type"]) for s in d["shots"]] == [(10, "three", 28.8, None), (164, "paint", 2.9, "layup")]
    assert d["shot_distribution"]["pct_three"] == 50.0 and d["meta"]["make_miss_available"] is False and docs[2]["box_score"] is None
    stats.write_bundles(made, str(tmp_path / "b"))
    assert readers.same_rows(stats.read_bundles(spark, str(tmp_path / "b"), made).select(F.to_json("doc").alias("d")), made.select(F.to_json("doc").alias("d")))
    assert (tmp_path / "b" / "clip_id=1").exists()


def test_query_bundles_hold_their_clips_shots(spark):
    """``h8_measured_stats``: each shot once, charted with its own frames where it is located, else counted, as a plain loop has it."""
    shot, o, t = (adapters.load(spark, SF, n).collect() for n in ("shots", "oncourt", "tracks"))
    at = {(r.clip_id, r.frame, r.track_id): r for r in o}
    located, lost, tries = {r.clip_id: [] for r in t}, {r.clip_id: 0 for r in t}, {}
    for s in shot:
        if s.shot_id % 4:
            key = (s.clip_id, s.start_frame, s.end_frame)
            tries[key] = min(tries.get(key, ("jumpshot", s.hoop)), ("jumpshot", s.hoop))
    for s in shot:
        spot = at.get((s.clip_id, s.start_frame, s.track_id))
        if spot is not None and spot.is_on:
            located[s.clip_id].append((s.start_frame, s.end_frame, spot.court_x, spot.court_y, *tries.get((s.clip_id, s.start_frame, s.end_frame), (None, None)), "review_item"))
        else:
            lost[s.clip_id] += 1
    docs = {r.clip_id: json.loads(r.doc) for r in queries.QUERIES["h8_measured_stats"](spark, SF).collect()}
    fields = ("start_frame", "end_frame", "court_x", "court_y", "shot_type", "hoop", "shooter_status")
    got = {c: [tuple(s[f] for f in fields) for s in d["shots"] or []] for c, d in docs.items()}
    assert {c: sorted(v, key=repr) for c, v in got.items()} == {c: sorted(v, key=repr) for c, v in located.items()} and any(located.values())
    assert {c: d["shots_unlocated"] for c, d in docs.items()} == lost
    assert {c: (d["shot_distribution"] or {"n": 0})["n"] for c, d in docs.items()} == {c: len(v) for c, v in located.items()}
    lines = {c: d["box_score"] or [] for c, d in docs.items()}
    assert any(lines.values()) and all(d["tracking"]["named_seconds"] == pytest.approx(sum(b["seconds_total"] for b in lines[c]), abs=0.051) for c, d in docs.items())


def test_team_document(spark):
    events = spark.createDataFrame([(1, 51, "right"), (1, 0, "left")], "clip_id long, start long, side string")
    heat = spark.createDataFrame([(1, "a", 3.0, 4.0), (1, "a", 1.0, 2.0)], "clip_id long, team string, court_x double, court_y double")
    one = spark.createDataFrame([(1, 250)], "clip_id long, frames_processed long")
    d = stats.team_document(events, heat, one, one).first().doc.asDict(True)
    assert d["schema_version"] == 1 and [(e["start"], e["approx"]) for e in d["team_events"]] == [(0, True), (51, True)] and d["heatmap_data"]["a"] == [[1.0, 2.0], [3.0, 4.0]]


# -- operators that had no test of their own -----------------------------------------------------------------------------------------


def test_coverage_diagnostics_and_breaks(spark):
    events = spark.createDataFrame([(1, f) for f in range(60)] + [(2, 0)], "clip_id long, frame long")
    lines = spark.createDataFrame([(1, 1.0), (1, 0.5)], "clip_id long, seconds_total double")
    got = {r.clip_id: (r.named_s, r.unnamed_s, r.pct) for r in identity.tracking_coverage(lines, events).collect()}
    assert got[1] == (1.5, 0.5, 75.0) and got[2][0] == 0.0
    diffs = spark.createDataFrame([(1, f, float(d)) for f, d in enumerate((1, 30, 60, 2))], "clip_id long, frame long, diff double")
    r = audit.clip_diagnostics(diffs, 30.0, 60.0).first()
    assert (r.cuts, r.lost, r.frames, r.largest) == (2, 1, 4, 60.0)
    told = spark.createDataFrame([(1, 0, 4, 9, "relinked", 3, 1.5), (1, 0, 4, 10, "continuing", None, None)], "clip_id long, window long, track_id long, frame long, reason string, gap_frames long, distance_px double")
    assert [r.frame for r in identity.breaks(told).collect()] == [9]


def test_apexes_and_releases(spark):
    found = spark.createDataFrame([(1, 0, 0, 0, 2, 6)], "clip_id long, island long, chain long, arc long, start_frame long, end_frame long")
    points = spark.createDataFrame([(1, 0, 0, f, 10.0 * f, float((f - 4) ** 2 + 5)) for f in range(9)], "clip_id long, island long, chain long, frame long, cx double, cy double")
    r = ball.apexes(found, points).first()
    assert (r.apex_frame, r.apex_y) == (4, 5.0)
    shots = spark.createDataFrame([(1, 20, [0.0, 5.0, 100.0], [0.0, 0.0, 50.0])], "clip_id long, start_frame long, fit_x array<double>, fit_y array<double>")
    bodies = spark.createDataFrame([(1, 19, 0, 4, 80.0, 0.0, 90.0, 100.0), (1, 18, 0, 4, 85.0, 0.0, 95.0, 100.0), (1, 18, 1, 7, 300.0, 0.0, 310.0, 100.0)], "clip_id long, frame long, track_pos long, track_id long, x1 double, y1 double, x2 double, y2 double")
    r = ball.releases(shots, points, bodies).first()
    assert (r.track_id, r.release_frame, r.dist) == (4, 18, 0.0)


def stream(spark, tmp_path, rows, schema, build, name):
    """Runs ``build`` over files, one a batch, and returns what it appended."""
    import os

    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis(F.col("ts"))).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        for f in os.listdir(tmp_path / "in" / f"b{k}"):
            os.utime(tmp_path / "in" / f"b{k}" / f, (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(schema.replace("ts long", "ts timestamp")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_streamed_zones_sessions_and_duplicates(spark, tmp_path):
    kind = "clip_id long, track_id long, frame long, court_x double, court_y double, ts long"
    row = lambda ms, t=1: (1, t, ms // 33, 3.0, 25.0, 1_000_000 + ms)
    rows = [[row(0), row(100), row(200)], [row(3000), row(3100)], [row(60_000)], [row(61_000)], [row(500), row(90_000)], [row(120_000)]]
    got = stream(spark, tmp_path / "z", rows, kind, presence.windowed_zones, "zones")
    n = {r.window.start.timestamp(): r.n for r in got}
    assert n[1000.0] == 3 and n[1002.0] == 2 and all(r.zone == "PAINT" for r in got)  # the late row of the fifth batch is dropped
    got = stream(spark, tmp_path / "s", rows, kind, presence.presence_sessions, "sessions")
    assert sorted(r.n for r in got)[-2:] == [2, 3]
    twice = [[row(0), row(0), row(33)], [row(33), row(66)], [row(60_000)]]
    got = stream(spark, tmp_path / "d", twice, kind, presence.deduplicated, "dedup")
    assert sorted(r.frame for r in got) == [0, 1, 2, 1818]
