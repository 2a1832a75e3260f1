"""Identities: the fold, its stream, seeds, resolutions, merges and shared numbers against plain loops and literal rows."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from courtflow import identity_queries, queries
from courtflow.operators import duals, identity, merge, resolutions, seeding, team
from courtflow.sources import adapters
from courtflow.streaming import identities

SF = "/root/testdata/sf0.001"
BOX = "clip_id long, window long, frame long, track_id long, track_pos long, x1 double, y1 double, x2 double, y2 double"


def plain_machine(rows, seeds):
    """Frame by frame over all tracks of a window. ``rows``: (clip, window, frame, track, pos, x, y)."""
    out = {}
    frames = sorted({(r[0], r[2]) for r in rows})
    window_of = {(r[0], r[2]): r[1] for r in rows}
    at = {}
    for r in rows:
        at.setdefault((r[0], r[2]), []).append(r)
    active, lost, counts, current = {}, [], {}, None
    for clip, frame in frames:
        window = window_of[clip, frame]
        if (clip, window) != current:
            active, lost, counts, current = {}, [], {}, (clip, window)
        here = {r[3] for r in at[clip, frame]}
        for t in [t for t in active if t not in here]:
            lost.append(active.pop(t))
        for _, _, _, t, _, x, y in sorted(at[clip, frame], key=lambda r: r[4]):
            if t not in active:
                met = []
                for i in lost:
                    if i["track"] != t or not 0 < frame - i["seen"][-1][0] <= 30:
                        continue
                    (fa, xa, ya), (fb, xb, yb) = i["seen"][0], i["seen"][-1]
                    gap, steps = frame - fb, max(1, fb - fa)
                    px, py = xb + (xb - xa) / steps * gap, yb + (yb - ya) / steps * gap
                    d = round(math.hypot(x - px, y - py), 1)
                    if min(math.hypot(x - px, y - py), math.hypot(x - xb, y - yb)) <= 150:
                        met.append((d, i))
                met.sort(key=lambda m: m[0])
                if met and (len(met) == 1 or met[0][0] * 1.5 <= met[1][0]):
                    active[t] = met[0][1]
                    lost.remove(met[0][1])
                    active[t]["state"] = "candidate"
                else:
                    n = counts.get(t, 0)
                    counts[t] = n + 1
                    fresh = n == 0 and (clip, window, t) in seeds
                    active[t] = {"track": t, "run": n, "state": "confirmed" if fresh else "unknown", "seen": []}
            active[t]["seen"] = (active[t]["seen"] + [(frame, x, y)])[-5:]
            out[clip, window, frame, t] = (active[t]["run"], active[t]["state"])
    return out


def random_boxes(seed, tracks=5, frames=150):
    """Tracks that come, go, drift and jump, so that identities are relinked, contended and made anew."""
    rng = random.Random(seed)
    rows = []
    for t in range(tracks):
        x, y, there = rng.uniform(0, 300), rng.uniform(0, 300), True
        for f in range(frames):
            if rng.random() < (0.15 if there else 0.2):
                there = not there
                if rng.random() < 0.4:
                    x, y = x + rng.choice([-1, 1]) * rng.uniform(60, 400), y + rng.uniform(-100, 100)
            x, y = x + rng.uniform(-6, 6), y + rng.uniform(-6, 6)
            if there:
                rows.append((1, f // 70, f, t, t, x - 5.0, y - 9.0, x + 5.0, y + 9.0))
    return [r for r in rows if r[2] % 37 != 5]  # frames that the clip lacks are no absence


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_plain_machine(spark, seed):
    rows = random_boxes(seed)
    given = {(1, w, t) for w in range(3) for t in range(5) if (w + t) % 2}
    got = identity.identity_runs(spark.createDataFrame(rows, BOX), spark.createDataFrame(sorted(given), "clip_id long, window long, track_id long")).collect()
    want = plain_machine([(*r[:5], (r[5] + r[7]) / 2, (r[6] + r[8]) / 2) for r in rows], given)
    assert {(r.clip_id, r.window, r.frame, r.track_id): (r.run, r.state) for r in got} == want and len(got) == len(rows)
    assert {"relinked", "new track", "continuing", "seed"} <= {r.reason for r in got}


def test_st1_query_equals_plain_machine(spark):
    t = adapters.load(spark, SF, "tracks").collect()
    want = plain_machine([(r.clip_id, r.frame // 60, r.frame, r.track_id, r.track_pos, (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2) for r in t], set())
    got = queries.QUERIES["st1_identity_events"](spark, SF).collect()
    assert {(r.clip_id, r.window, r.frame, r.track_id): (r.run, r.state) for r in got} == want


def stream_events(spark, tmp_path, rows, seeds=None, batches=6):
    """Runs the stream over files, one a batch, in the order of ``rows``."""
    schema = BOX + ", ord long, ts timestamp"
    files = tmp_path / "in"
    files.mkdir()
    size = -(-len(rows) // batches)
    order = {f: i for i, f in enumerate(sorted({r[2] for r in rows}))}
    for k in range(batches):
        part = rows[k * size : (k + 1) * size]
        if part:
            table = spark.createDataFrame([(*r, order[r[2]]) for r in part], BOX + ", ord long").withColumn("ts", F.timestamp_millis((F.lit(1_000_000) + F.col("frame") * 1000 / 30).cast("long")))
            table.coalesce(1).write.mode("append").parquet(str(files / f"b{k}"))
            for name in os.listdir(files / f"b{k}"):
                os.utime(files / f"b{k}" / name, (1_700_000_000 + k, 1_700_000_000 + k))
    spark.conf.set(*identities.STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(files))
    name = f"events_{abs(hash(str(tmp_path)))}"
    query = identities.identity_stream(source, seeds).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_fold_does_not_see_where_batches_end(spark, size):
    """Tracks of several clips and windows in batches of a few rows: the same events, each track's rows waiting for its last one."""
    rows = random_boxes(3)
    tracks = spark.createDataFrame([(c, *r[1:]) for c in (1, 2) for r in rows], BOX)
    whole = sorted(map(tuple, identity.identity_runs(tracks).collect()), key=repr)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        runs = identity.identity_runs(tracks)
        assert "GroupsInPandas" not in runs._jdf.queryExecution().executedPlan().toString()  # a call a window cost more than its rows
        assert sorted(map(tuple, runs.collect()), key=repr) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_tables_from_events_share_one_deduplication(spark):
    unique = adapters.unique_events(spark, SF)
    for name in filter(adapters.from_events, adapters.SQL):
        own, shared = adapters.load(spark, SF, name), adapters.load(spark, SF, name, unique)
        assert "event_id ASC" not in shared._jdf.queryExecution().optimizedPlan().toString() and own.schema == shared.schema
        assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, shared.collect()), key=repr)


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(random_boxes(9, 4, 150), key=lambda r: (r[2], r[3]))
    seeds = spark.createDataFrame([(1, w, t) for w in range(3) for t in (0, 2)], "clip_id long, window long, track_id long")
    got = stream_events(spark, tmp_path, rows, seeds)
    batch = identity.identity_runs(spark.createDataFrame(rows, BOX), seeds).collect()
    key = lambda r: (r.clip_id, r.window, r.frame, r.track_id, r.run, r.state, r.reason, r.gap_frames, r.distance_px)
    assert sorted(map(key, got), key=repr) == sorted(map(key, batch), key=repr)
    assert {"relinked", "seed"} <= {r.reason for r in got}


def test_stream_refuses_rows_out_of_order(spark, tmp_path):
    rows = [(1, 0, f, 1, 0, 0.0, 0.0, 9.0, 9.0) for f in (0, 1, 2, 3, 4, 5)] + [(1, 0, f, 1, 0, 0.0, 0.0, 9.0, 9.0) for f in (4, 6, 6, 2, 7, 8)]
    got = stream_events(spark, tmp_path, rows, batches=2)
    assert sorted((r.frame, r.state) for r in got) == sorted([(f, "unknown") for f in (0, 1, 2, 3, 4, 5, 6, 7, 8)] + [(4, "refused"), (2, "refused"), (6, "refused")])


EV = "clip_id long, window long, frame long, identity_id long, state string"
NUM = "clip_id long, window long, identity_id long, number long"
TRIG = "clip_id long, window long, identity_id long, number long, source string, ord long"


def plain_merge(events, numbers, triggers):
    """One trigger after the other over a list of mutable events."""
    rows = [dict(zip(("clip_id", "window", "frame", "identity_id", "state"), e)) | {"merge": None} for e in events]
    told = {(c, w, i): n for c, w, i, n in numbers}
    credited, merged, verdicts = {}, {}, []
    for e in rows:
        n = told.get((e["clip_id"], e["window"], e["identity_id"]))
        if e["state"] == "confirmed" and n is not None:
            credited.setdefault((e["clip_id"], e["window"], n), set()).add(e["frame"])
    for c, w, i, n, source, _ in sorted(triggers, key=lambda t: (t[4] != "ocr", t[5])):
        key = (c, w, i)
        if n is None:
            verdicts.append((c, w, i, n, source, "rejected", 0))
            continue
        if source == "human" and key in merged:
            verdicts.append((c, w, i, n, source, "repeated" if merged[key] == n else "conflict", 0))
            continue
        own = [e for e in rows if (e["clip_id"], e["window"], e["identity_id"]) == key]
        if not own:
            verdicts.append((c, w, i, n, source, "unknown_identity", 0))
            continue
        take = [e for e in own if e["state"] in (("candidate",) if source == "ocr" else ("candidate", "unknown"))]
        frames = {e["frame"] for e in take}
        if frames & credited.get((c, w, n), set()):
            verdicts.append((c, w, i, n, source, "contradiction", 0))
            continue
        for e in take:
            e["state"], e["merge"] = "confirmed_retroactive", (n, source)
        credited.setdefault((c, w, n), set()).update(frames)
        merged[key] = n
        verdicts.append((c, w, i, n, source, "merged", len(frames)))
    return verdicts, [(e["clip_id"], e["window"], e["frame"], e["identity_id"], e["state"], e["merge"]) for e in rows]


@pytest.mark.parametrize("seed", range(6))
def test_merges_equal_plain_loop(spark, seed):
    rng = random.Random(seed)
    events = [(1, w, f, i, rng.choice(["confirmed", "candidate", "candidate", "unknown", "lost"])) for w in range(3) for i in range(8) for f in range(w * 20, w * 20 + 20) if rng.random() < 0.15 + 0.1 * seed]
    numbers = [(1, w, i, rng.choice([5, 7, 9])) for w in range(3) for i in range(8) if i % 2]
    triggers = [(1, rng.randrange(3), rng.randrange(9), rng.choice([5, 7, 9, 11, 13]), rng.choice(["ocr", "human"]), k) for k in range(20)]
    triggers += [(1, rng.randrange(3), rng.randrange(8), None, "human", 20 + k) for k in range(3)]
    e, n, t = (spark.createDataFrame(r, s) for r, s in ((events, EV), (numbers, NUM), (triggers, TRIG)))
    verdicts = merge.merge_verdicts(e, n, t)
    want, rows = plain_merge(events, numbers, triggers)
    assert sorted(((r.clip_id, r.window, r.identity_id, r.number, r.source, r.verdict, r.n_frames) for r in verdicts.collect()), key=repr) == sorted(want, key=repr)
    got = [(r.clip_id, r.window, r.frame, r.identity_id, r.state, tuple(r.merge) if r.merge else None) for r in merge.merged_events(e, verdicts).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("numbers", [(5, 7), (5, 5)])
def test_two_reads_of_one_identity_stamp_it_once(spark, numbers):
    events = spark.createDataFrame([(1, 0, f, 4, "candidate") for f in range(3)], EV)
    none = spark.createDataFrame([], NUM)
    triggers = spark.createDataFrame([(1, 0, 4, n, "ocr", k) for k, n in enumerate(numbers)], TRIG)
    verdicts = merge.merge_verdicts(events, none, triggers)
    assert sorted((r.verdict, r.n_frames) for r in verdicts.collect()) == [("merged", 0), ("merged", 3)]
    got = merge.merged_events(events, verdicts).collect()
    assert len(got) == 3 and {tuple(r.merge) for r in got} == {(5, "ocr")}


def test_merged_query_keeps_its_rows(spark):
    got = queries.QUERIES["u3_merged_events"](spark, SF)
    assert got.count() == adapters.load(spark, SF, "tracks").count()


def test_late_seeds_need_a_number_and_a_first_appearance(spark):
    rows = [(1, 0, f, t, t) for f in range(10) for t in (1, 2)] + [(1, 0, f, t, t) for f in range(4, 10) for t in (3, 4, 5, 6, 7)]
    tracks = spark.createDataFrame(rows, "clip_id long, window long, frame long, track_id long, track_pos long")
    votes = spark.createDataFrame([(1, 0, t, t != 7) for t in range(1, 8)], "clip_id long, window long, track_id long, on_court boolean")
    typed = spark.createDataFrame([(1, 1, "ref", None), (1, 3, "number", 23), (1, 4, "none", None), (1, 5, "refused", None), (1, 6, "number", 8), (1, 7, "number", 9)], "clip_id long, track_id long, kind string, number int")
    excluded = spark.createDataFrame([(1, 1), (1, 6)], "clip_id long, track_id long")
    got = seeding.seeds(tracks, votes, typed, excluded)
    assert sorted((r.track_id, r.reason) for r in got.collect()) == [(2, "seed"), (3, "late seed")]
    stray = spark.createDataFrame([(1, 0, 2), (1, 0, 99)], "clip_id long, window long, track_id long")
    assert [r.track_id for r in seeding.unmatched_seeds(stray, tracks).collect()] == [99]


def test_a_relinked_candidate_is_never_seeded(spark):
    """A labelled body that was there before its gap stays a candidate; the seed is for its first identity only."""
    rows = [(1, 0, f, 9, 0, 0.0, 0.0, 9.0, 9.0) for f in range(20)] + [(1, 0, f, 1, 1, 0.0, 0.0, 9.0, 9.0) for f in (3, 4, 9, 10)]
    tracks = spark.createDataFrame(rows, BOX)
    given = spark.createDataFrame([(1, 0, 1, "late seed")], "clip_id long, window long, track_id long, reason string")
    got = {r.frame: (r.state, r.reason) for r in identity.identity_runs(tracks, given).where("track_id = 1").collect()}
    assert got[3] == ("confirmed", "late seed") and got[9] == ("candidate", "relinked") and got[10] == ("candidate", "continuing")


def test_resolutions_are_applied_by_track_or_refused(spark):
    kind = "clip_id long, window long, track_id long, number string, needs_review string, made_against array<long>, ord long"
    rows = [(1, 0, 17, "13", None, [0, 60], 0), (1, 0, 17, "99", None, [0, 60], 1), (1, 0, None, "13", None, [0, 60], 2), (1, 0, 18, "reject", None, None, 3), (1, 1, 17, "13", None, [0, 60], 4), (1, 0, 17, "13", "moved", [60, 0], 5), (1, 0, 17, None, None, None, 6), (2, 0, 17, "13", None, [0, 61], 7), (2, 0, 17, "13", None, None, 8)]
    given = spark.createDataFrame(rows, kind)
    starts = spark.createDataFrame([(c, s) for c in (1, 2) for s in (0, 60)], "clip_id long, start long")
    rosters = spark.createDataFrame([(1, "a", 13), (2, "a", 13)], "clip_id long, team string, number long")
    events = spark.createDataFrame([(c, 0, f, t, i) for c in (1, 2) for f, t, i in ((1, 17, 4), (9, 17, 6), (2, 18, 5))], "clip_id long, window long, frame long, track_id long, identity_id long")
    got = {r.ord: (r.status, r.identity_id, r.reason) for r in resolutions.checked(given, starts, rosters, events).collect()}
    assert got[0] == ("applied", 6, None) and got[3] == ("applied", 5, None)
    assert [got[i][2] for i in (1, 2, 4, 5, 6)] == ["off roster", "no track", "track not in the window", "needs review: moved", "off roster"]
    assert {got[i] for i in (7, 8)} == {("refused", None, "windows have moved")}
    triggers = resolutions.human_triggers(resolutions.checked(given, starts, rosters, events)).collect()
    assert sorted((r.identity_id, r.number) for r in triggers) == [(5, None), (6, 13)]


def test_box_score_reads_the_stamp_before_the_registry(spark):
    kind = "clip_id long, window long, frame long, identity_id long, track_id long, state string, merge struct<number: long, source: string>"
    events = spark.createDataFrame([(1, 0, 0, 4, 4, "confirmed", None), (1, 0, 1, 4, 4, "confirmed_retroactive", (44, "human")), (1, 0, 2, 5, 5, "confirmed", None), (1, 0, 3, 5, 5, "candidate", None), (1, 0, 4, 5, 5, "unknown", None)], kind)
    numbers = spark.createDataFrame([(1, 0, 4, 13), (1, 0, 5, None)], NUM)
    places = spark.createDataFrame([(1, f, t, 3.0, 25.0, t != 6) for f in range(5) for t in (4, 5, 6)], "clip_id long, frame long, track_id long, court_x double, court_y double, is_on boolean")
    got = {r.number: (r.seconds_live, r.seconds_retro) for r in identity.box_score(events, numbers, places, 1.0).collect()}
    assert got == {13: (1.0, 0.0), 44: (0.0, 1.0)}
    s = identity.box_summary(events, numbers, places, spark.createDataFrame([(1, 5)], "clip_id long, track_id long"), 1.0).first()
    assert (s.unnamed_identities, s.unnamed_seconds, s.candidate_events, s.unknown_events, s.readable_seconds) == (1, 1.0, 1, 1, 5.0)


def test_shared_numbers_go_by_colour_or_to_nobody(spark):
    """Numbers 1 (red) and 2 (green) tell the teams' colours; identities 7 and 8 carry number 7 of both; 9's crops are between."""
    tone = {1: (0.0, 0.0, 255.0), 2: (0.0, 255.0, 0.0), 7: (0.0, 20.0, 235.0), 8: (0.0, 235.0, 20.0), 9: (0.0, 127.5, 127.5)}
    events = spark.createDataFrame([(1, 0, f, i, i, "confirmed") for i in tone for f in range(20)], "clip_id long, window long, frame long, identity_id long, track_id long, state string")
    numbers = spark.createDataFrame([(1, 0, i, i if i < 3 else 7) for i in tone], NUM)
    rosters = spark.createDataFrame([(1, "red", 1), (1, "green", 2), (1, "red", 7), (1, "green", 7)], "clip_id long, team string, number long")
    crops = spark.createDataFrame([(1, f, i, *c) for i, c in tone.items() for f in range(20)], "clip_id long, frame long, track_id long, c0 double, c1 double, c2 double")
    got = {r.identity_id: r.team for r in duals.dual_teams(events, numbers, rosters, crops).collect()}
    assert got == {7: "red", 8: "green", 9: None}
    places = spark.createDataFrame([(1, 0, 0, 0.0, 0.0)], "clip_id long, frame long, track_id long, court_x double, court_y double")
    lines = identity.box_score(events, numbers, places, 1.0, rosters=rosters, identity_teams=duals.dual_teams(events, numbers, rosters, crops))
    assert {r.team for r in lines.where("number = 7").collect()} == {"AMBIGUOUS (green / red)"}  # all three claim the same frames
    one = spark.createDataFrame([(1, "red", 1), (1, "green", 2)], "clip_id long, team string, number long")
    assert duals.dual_teams(events, numbers, one, crops).count() == 0
    assert {r.team for r in duals.dual_teams(events.where("identity_id <> 2"), numbers, rosters, crops).collect()} == {None}


def test_flagship_agrees_with_a_plain_run(spark):
    """Live and retroactive frames by number, from the plain machine and the plain merge over the flagship's own seeds and windows."""
    t, o, r, labels, rosters = (adapters.load(spark, SF, n) for n in ("tracks", "oncourt", "reads", "labels_typed", "rosters"))
    run = identity_queries.box.identify(t, o, r, labels, rosters, 10.0)
    placed = team.window_of(t, identity_queries.box.possession_starts(o, 10.0)).collect()
    given = {(s.clip_id, s.window, s.track_id) for s in run.seeds.collect()}
    told = plain_machine([(p.clip_id, p.window, p.frame, p.track_id, p.track_pos, (p.x1 + p.x2) / 2, (p.y1 + p.y2) / 2) for p in placed], given)
    events = run.events.collect()
    assert {(e.clip_id, e.window, e.frame, e.track_id): (e.run, e.state) for e in events} == told and len(events) == len(told)
    assert {"seed", "late seed"} >= {s.reason for s in run.seeds.collect()} and any(e.state == "confirmed" for e in events)
    numbers = [(x.clip_id, x.window, x.identity_id, x.number) for x in run.registry.collect() if x.number is not None]
    triggers = [(x.clip_id, x.window, x.identity_id, x.number, x.source, x.ord) for x in seeding.agree_triggers(run.outcomes).collect()]
    _, rows = plain_merge([(e.clip_id, e.window, e.frame, e.identity_id, e.state) for e in events], numbers, triggers)
    got = [(e.clip_id, e.window, e.frame, e.identity_id, e.state, tuple(e.merge) if e.merge else None) for e in identity_queries.box.credited(run).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_review_items_tell_where_to_look_and_why(spark):
    rows = [(f, 9, 0) for f in range(30)] + [(f, 1, 0) for f in (0, 1, 2, 6, 7)] + [(f, 2, 300) for f in range(10, 20)]
    tracks = spark.createDataFrame([(1, 0, f, t, t, float(x), 0.0, x + 10.0, 20.0) for f, t, x in rows], BOX)
    given = spark.createDataFrame([(1, 0, 9), (1, 0, 1)], "clip_id long, window long, track_id long")
    got = {r.track_id: (r.state, r.frame, r.why, r.rank) for r in seeding.review_items(identity.with_identity_ids(identity.identity_runs(tracks, given))).collect()}
    assert got == {1: ("candidate", 6, "candidate: back after 4 frames, 0.0 px from where motion would have it; no second signal", 1), 2: ("unknown", 15, "unknown: new track", 2)}
