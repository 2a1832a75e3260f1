"""Corrected rules on literal rows, the kernels against plain versions, and merges."""

from itertools import combinations

import numpy as np
import pytest

from courtflow import report_queries  # noqa: F401  registers its queries
from courtflow.operators import ball, identity, merge, reports, shots, team


def test_a_disputed_frame_counts_once_whatever_its_zones(spark):
    events = spark.createDataFrame([(1, 0, 5, 1, 11, "confirmed"), (1, 0, 5, 2, 12, "confirmed"), (1, 0, 6, 1, 11, "confirmed")], "clip_id long, window long, frame long, identity_id long, track_id long, state string")
    numbers = spark.createDataFrame([(1, 0, 1, 7), (1, 0, 2, 7)], "clip_id long, window long, identity_id long, number long")
    places = spark.createDataFrame([(1, 5, 11, 3.0, 25.0), (1, 5, 12, 40.0, 25.0)], "clip_id long, frame long, track_id long, court_x double, court_y double")
    (r,) = identity.box_score(events, numbers, places, 1.0).collect()
    assert (r.disputed_frames, r.seconds_live, r.unpositioned_frames, r.top_zone, r.team) == (1, 1.0, 1, None, "off-roster?")
    rosters = spark.createDataFrame([(1, "b", 7), (1, "a", 7)], "clip_id long, team string, number long")
    own = spark.createDataFrame([(1, 0, 1, "a")], "clip_id long, window long, identity_id long, team string")
    got = {r.team: (r.seconds_total, r.disputed_frames) for r in identity.box_score(events, numbers, places, 1.0, rosters=rosters, identity_teams=own).collect()}
    assert got == {"a": (1.0, 0), "AMBIGUOUS (a / b)": (0.0, 1)}


def signal(spark, parts):
    rows, f = [], 0
    for x, n in parts:
        for _ in range(n):
            rows.append((1, f, x))
            f += 1
    return spark.createDataFrame(rows, "clip_id long, frame long, mean_x double")


def test_possessions_follow_the_rules_of_edges(spark):
    # 48.0 is within the dead zone of 42 +- 6, so it is on no side
    got = team.possessions_v2(signal(spark, [(20.0, 60), (48.0, 60), (None, 5)]), fps=10.0).collect()
    assert [(r.side, r.start, r.end, r.partial_end) for r in got] == [("left", 0, 59, True)]
    # an inner blip falls to the segment before, a short last one stays and is partial
    got = team.possessions_v2(signal(spark, [(20.0, 60), (60.0, 20), (20.0, 60), (60.0, 16)]), fps=10.0).orderBy("start").collect()
    assert [(r.side, r.start, r.end) for r in got] == [("left", 0, 139), ("right", 140, 155)]
    assert got[0].side_agreement == 0.857 and (got[0].partial_start, got[1].partial_end) == (True, True)
    # the old rule: a possession ends at the frame where the next begins
    got = team.possessions_v1(signal(spark, [(20.0, 50), (60.0, 50)]), hold=30).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 79), (79, 99)]
    spans = spark.createDataFrame([(1, 0, 99), (2, 0, 99)], "clip_id long, span_start long, span_end long")
    one = spark.createDataFrame([(1, "left", 5, 60), (1, "right", 61, 99)], "clip_id long, side string, start long, end long")
    got = sorted((r.clip_id, r.start, r.from_possessions) for r in team.possession_windows(one, spans, 50).collect())
    assert got == [(1, 0, True), (1, 61, True), (2, 0, False), (2, 50, False)]


def test_touching_numbers_are_not_interleaved(spark):
    reads = spark.createDataFrame([(1, 1, 0, 4, 0.9), (1, 1, 5, 4, 0.9), (1, 1, 5, 9, 0.9), (1, 1, 8, 9, 0.9)], "clip_id long, track_id long, frame long, number long, conf double")
    (r,) = identity.purity(reads).collect()
    assert (r.verdict, r.interleaved, r.splice_from, r.splice_to) == ("spliced", False, 5, 5)


def plain_fit(t, x, y):
    t = np.asarray(t, float) - t[0]
    py, px = np.polyfit(t, y, 2), np.polyfit(t, x, 2)
    rms = [np.sqrt(np.mean((np.polyval(p, t) - v) ** 2)) for p, v in ((py, y), (px, x))]
    return 0.3 <= 2 * py[0] <= 3.0 and abs(2 * px[0]) <= 1.5 and max(rms) <= 3.0 and np.ptp(y) >= 25.0


@pytest.mark.parametrize("seed", range(6))
def test_flights_by_sums_equal_plain_fits(seed):
    rng = np.random.default_rng(seed)
    t = np.arange(40.0) + 100
    x = 300 + 4.0 * (t - 100) + rng.normal(0, 1.5, 40)
    y = 200 + 0.4 * (t - 112) ** 2 + rng.normal(0, 1.5, 40)
    y[25:] += rng.choice([0, 30])
    n, facts = ball._grown(t, x, y)
    want = 0
    for j in range(ball.MIN_FIT, 41):
        if not plain_fit(t[:j], x[:j], y[:j]):
            break
        want = j
    assert n == want and (facts is None) == (want == 0)
    if want:
        assert np.allclose(facts[5], np.polyfit(t[:want] - t[0], y[:want], 2), atol=1e-6)


def test_a_flight_with_junk_is_rescued(spark):
    f = np.arange(11)
    x, y = 100.0 + 5 * f, 300 + 0.6 * (f - 5.0) ** 2 * 2
    for k in (2, 6, 8):
        x[k] += 25
    rows = [(1, 0, 0, int(k), float(a), float(b)) for k, a, b in zip(f, x, y)]
    (r,) = ball.arcs(spark.createDataFrame(rows, "clip_id long, island long, chain long, frame long, cx double, cy double")).collect()
    best = next(c for k in range(1, 4) for c in combinations(range(11), k) if plain_fit(*(np.delete(v, c) for v in (f.astype(float), x, y))))
    assert r.n_dropped == len(best) == 3 and r.n_points == 8


def test_chains_take_the_nearest_first(spark):
    rows = [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 100.0, 0.0), (1, 1, 2, 12.0, 0.0), (1, 1, 3, 95.0, 0.0), (1, 1, 4, 30.0, 0.0), (1, 9, 5, 12.0, 0.0)]
    got = ball.chain_points(spark.createDataFrame([(*r, 0.5) for r in rows], "clip_id long, frame long, det_idx long, cx double, cy double, conf double")).collect()
    chains = {}
    for r in got:
        chains.setdefault((r.island, r.chain), []).append((r.frame, r.cx))
    assert sorted(map(sorted, chains.values())) == [[(0, 0.0), (1, 12.0)], [(0, 100.0), (1, 95.0)], [(1, 30.0)], [(9, 12.0)]]


def test_merges_contradict_conflict_and_reject(spark):
    ev = lambda who, frames, state: [(1, 0, f, who, state) for f in frames]
    rows = ev(1, range(5), "confirmed") + ev(2, range(5, 9), "candidate") + ev(3, range(3, 6), "candidate") + ev(4, range(20, 22), "candidate") + ev(4, range(22, 25), "unknown") + ev(4, [30], "lost")
    events = spark.createDataFrame(rows, "clip_id long, window long, frame long, identity_id long, state string")
    numbers = spark.createDataFrame([(1, 0, 1, 9)], "clip_id long, window long, identity_id long, number long")
    asks = [(2, 9, "ocr", 0), (3, 9, "ocr", 1), (2, 8, "human", 0), (2, 9, "human", 1), (4, 9, "human", 2), (5, 9, "human", 3), (3, None, "human", 4)]
    triggers = spark.createDataFrame([(1, 0, *a) for a in asks], "clip_id long, window long, identity_id long, number long, source string, ord long")
    verdicts = merge.merge_verdicts(events, numbers, triggers)
    got = {(r.identity_id, r.source, r.ord): (r.verdict, r.n_frames, list(r.overlap_frames), r.existing_number) for r in verdicts.collect()}
    assert got == {
        (2, "ocr", 0): ("merged", 4, [], None), (3, "ocr", 1): ("contradiction", 0, [3, 4, 5], None), (2, "human", 0): ("conflict", 0, [], 9),
        (2, "human", 1): ("repeated", 0, [], 9), (4, "human", 2): ("merged", 5, [], None), (5, "human", 3): ("unknown_identity", 0, [], None), (3, "human", 4): ("rejected", 0, [], None),
    }
    after = merge.merged_events(events, verdicts)
    assert after.where("state = 'confirmed_retroactive'").groupBy("merge.number", "merge.source").count().orderBy("source").collect() == [(9, "human", 5), (9, "ocr", 4)]
    assert after.count() == events.count() and after.where("identity_id = 4 and state = 'lost'").count() == 1


def test_shots_within_spans(spark):
    spans = spark.createDataFrame([(1, 7, 100, 140), (1, 8, 400, 420)], "clip_id long, span_id long, start_frame long, end_frame long")
    found = spark.createDataFrame([(1, 97, 143), (1, 400, 430)], "clip_id long, start_frame long, end_frame long")
    assert {r.span_id: r.inside for r in shots.contained(spans, found).collect()} == {7: True, 8: False}


def test_keyframes_that_agree_have_no_gap(spark):
    h = "h0 double, h1 double, h2 double, h3 double, h4 double, h5 double, h6 double, h7 double, h8 double"
    transforms = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (1, 9, 1.0, 0.0, 3.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], f"clip_id long, keyframe long, {h}")
    pairs = spark.createDataFrame([(1, 0, 9, 5.0, 5.0, 2.0, 5.0), (1, 0, 9, 5.0, 5.0, 2.0, 9.0)], "clip_id long, a long, b long, px double, py double, qx double, qy double")
    (r,) = reports.keyframe_gaps(pairs, transforms).collect()
    assert (r.mean_gap, r.max_gap, r.marks) == (2.0, 4.0, 2)
