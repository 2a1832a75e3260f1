"""Identity layer: votes, the identity state machine, confirmation, labels and the box score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.exprs import zone_of

#: Fixed values of the continuity gate and of reads.
MAX_GAP, MAX_DIST, HISTORY, AMBIGUOUS, CONFIDENT = 30, 150.0, 5, 1.5, 0.85


def on_court_vote(oncourt: DataFrame) -> DataFrame:
    """Strict majority of a window's votes; a tie is off."""
    votes = oncourt.groupBy("clip_id", "window", "track_id").agg(F.count_if("is_on").alias("on_n"), F.count_if(~F.col("is_on")).alias("off_n"))
    return votes.withColumn("on_court", F.col("on_n") > F.col("off_n"))


_EVENTS = "clip_id long, window long, frame long, track_id long, track_pos long, run int, state string, reason string, gap_frames long, distance_px double"


class TrackFold:
    """The identities of one track in one window: the present one, those that are lost, and how many there were.

    An identity is ``[run, state, points]``; ``points`` are its last places as (frame, x, y). Batches and streams share it.
    """

    def __init__(self, now: list | None = None, lost: list | None = None, n: int = 0):
        self.now, self.lost, self.n = now, lost or [], n

    def leave(self) -> None:
        """The track was missing in a frame of its clip."""
        if self.now is not None:
            self.lost.append(self.now)
            self.now = None

    def arrive(self, frame: int, x: float, y: float, seed: str | None = None) -> tuple[str, int | None, float | None]:
        """The track is there (again): the same identity as a candidate, or a new one. Returns reason, gap and distance."""
        met = []
        for i, (run, _, points) in enumerate(self.lost):
            (f1, x1, y1), (f0, x0, y0) = points[0], points[-1]
            wait = frame - f0
            if not 0 < wait <= MAX_GAP:
                continue
            steps = max(1, f0 - f1)
            ahead = math.hypot(x - x0 - (x0 - x1) / steps * wait, y - y0 - (y0 - y1) / steps * wait)
            if min(ahead, math.hypot(x - x0, y - y0)) <= MAX_DIST:
                met.append((round(ahead, 1), i, wait))
        met.sort(key=lambda m: m[0])
        if met and (len(met) == 1 or met[0][0] * AMBIGUOUS <= met[1][0]):
            dist, i, gap = met[0]
            self.now = self.lost.pop(i)
            self.now[1] = "candidate"
            return "relinked", gap, dist
        first = self.n == 0 and seed is not None
        self.now = [self.n, "confirmed" if first else "unknown", []]
        self.n += 1
        return seed if first else "ambiguous reappearance" if met else "new track", None, None

    def stay(self, points: list[tuple[int, float, float]]) -> None:
        """Further places of the present identity, in order."""
        self.now[2] = (self.now[2] + points)[-HISTORY:]

    def forget(self, frame: int) -> None:
        """Drop lost identities that no reappearance after ``frame`` can reach."""
        self.lost = [i for i in self.lost if frame - i[2][-1][0] < MAX_GAP]


_TRACK = ["clip_id", "window", "track_id"]


def _fold_tracks(p: pd.DataFrame) -> pd.DataFrame:
    """The events of whole tracks of windows, ordered by ``_TRACK`` and frame: a step for each stretch of a track without a missing frame."""
    frame, order = p.frame.to_numpy(), p.ord.to_numpy()
    x, y = ((p.x1 + p.x2) / 2).to_numpy(), ((p.y1 + p.y2) / 2).to_numpy()
    fresh = np.ones(len(p), bool)
    fresh[1:] = np.logical_or.reduce([np.diff(p[c].to_numpy()) != 0 for c in _TRACK])
    new = fresh.copy()
    new[1:] |= np.diff(order) > 1
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(p)))
    seeds = p.seed.to_numpy(object)
    fold, runs, states, told = TrackFold(), [], [], []
    for a, n in zip(starts.tolist(), sizes.tolist()):
        if fresh[a]:
            fold = TrackFold()
        fold.leave()
        fold.forget(int(frame[a]) - 1)
        told.append(fold.arrive(int(frame[a]), float(x[a]), float(y[a]), seeds[a] if isinstance(seeds[a], str) else None))
        last = max(a, a + n - HISTORY)
        fold.stay(list(zip(frame[last : a + n].tolist(), x[last : a + n].tolist(), y[last : a + n].tolist())))
        runs.append(fold.now[0])
        states.append(fold.now[1])
    out = p[["clip_id", "window", "frame", "track_id", "track_pos"]].reset_index(drop=True)
    out["run"], out["state"] = np.repeat(np.array(runs, np.int32), sizes), np.repeat(np.array(states, object), sizes)
    reason, gap, dist = np.full(len(p), "continuing", object), np.full(len(p), None, object), np.full(len(p), None, object)
    for a, (r, g, d) in zip(starts, told):
        reason[a], gap[a], dist[a] = r, g, d
    out["reason"], out["gap_frames"], out["distance_px"] = reason, pd.array(gap, "Int64"), pd.array(dist, "Float64")
    return out


def _fold_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of ordered rows, many tracks in each; the rows of a batch's last track wait until another track follows."""
    held: list[pd.DataFrame] = []
    for p in batches:
        if not len(p):
            continue
        keys = p[_TRACK].to_numpy()
        others = np.flatnonzero((keys != keys[-1]).any(axis=1))
        k = int(others[-1]) + 1 if len(others) else 0
        if k or held and (held[0][_TRACK].to_numpy()[0] != keys[-1]).any():
            yield _fold_tracks(pd.concat([*held, p.iloc[:k]] if k else held, ignore_index=True))
            held = []
        held.append(p.iloc[k:])
    if held:
        yield _fold_tracks(pd.concat(held, ignore_index=True))


def identity_runs(tracks: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """ST1: the state of each tracked body in each frame of its window.

    ``tracks(clip_id, window, frame, track_id, track_pos, x1..y2)``; ``seeds(clip_id, window, track_id)`` confirm a track's
    first identity; their ``reason`` ("seed" without one) is that of its first row. A track away for a frame is lost; back within
    30 frames and 150 px (predicted or last place) it is the same identity, at most a candidate; else a new, unknown one. Two lost
    identities of the track contend by distance. As relinks stay on one track id, tracks of a window are folded apart, in order and many
    to a batch; presence is judged on the clip's own frames. ``run`` numbers a track's identities in the window.
    """
    place = F.dense_rank().over(Window.partitionBy("clip_id").orderBy("frame"))
    rows = tracks.where("clip_id is not null and frame is not null").withColumn("ord", place).where("track_id is not null")
    if seeds is None:
        rows = rows.withColumn("seed", F.lit(None).cast("string"))
    else:
        reason = F.min("reason") if "reason" in seeds.columns else F.lit("seed")
        rows = rows.join(seeds.groupBy(*_TRACK).agg(reason.alias("seed")).hint("merge"), _TRACK, "left")
    need = [*_TRACK, "frame", "track_pos", "x1", "y1", "x2", "y2", "ord", "seed"]
    dealt = rows.select(*need).repartition(*_TRACK).sortWithinPartitions(*_TRACK, "frame")
    return dealt.mapInPandas(_fold_batches, _EVENTS)


def with_identity_ids(events: DataFrame) -> DataFrame:
    """Window-scoped identity ids, ranked by first frame and place in the frame."""
    key = ["clip_id", "window", "track_id", "run"]
    first = F.min(F.struct("frame", "track_pos")).over(Window.partitionBy(*key))
    ranked = F.dense_rank().over(Window.partitionBy("clip_id", "window").orderBy("_f")) - 1
    return events.withColumn("_f", first).withColumn("identity_id", ranked).drop("_f")


def breaks(events: DataFrame) -> DataFrame:
    """Relinks and ambiguous reappearances."""
    return events.where(F.col("reason").isin("relinked", "ambiguous reappearance")).select("clip_id", "window", "track_id", "frame", "reason", "gap_frames", "distance_px")


def purity(reads: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """Per track no_evidence, consistent or spliced (with the two dominant numbers' order by midpoint)."""
    tracks = reads.select("clip_id", "track_id").distinct()
    good = reads.where(F.col("conf") >= least).groupBy("clip_id", "track_id", "number").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    mid = (F.col("first") + F.col("last")) / 2
    told = good.groupBy("clip_id", "track_id").agg(
        F.count(F.lit(1)).alias("numbers"), F.min_by("number", F.struct(mid, "number")).alias("early"), F.max_by("number", F.struct(mid, "number")).alias("late"),
        F.min_by("last", F.struct(mid, "number")).alias("early_last"), F.max_by("first", F.struct(mid, "number")).alias("late_first"),
    )
    verdict = F.when(F.col("numbers").isNull(), "no_evidence").when(F.col("numbers") == 1, "consistent").otherwise("spliced")
    out = tracks.join(told, ["clip_id", "track_id"], "left")
    return out.select("clip_id", "track_id", verdict.alias("verdict"), F.coalesce("numbers", F.lit(0)).alias("numbers"), "early", "late",
        (F.col("early_last") > F.col("late_first")).alias("interleaved"), *(F.when(F.col("numbers") > 1, f("early_last", "late_first")).alias(n) for f, n in ((F.least, "splice_from"), (F.greatest, "splice_to"))))


def readability(reads: DataFrame) -> DataFrame:
    """Attempts, confident reads and their rate."""
    out = reads.groupBy("clip_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("conf") >= CONFIDENT).alias("confident"))
    return out.withColumn("rate", F.try_divide("confident", "attempts"))


def best_reads(reads: DataFrame) -> DataFrame:
    """The best confident read of each track and window; the earliest frame wins a tie."""
    good = reads.where(F.col("conf") >= CONFIDENT)
    return good.groupBy("clip_id", "window", "track_id").agg(F.max_by(F.struct("number", "conf", "frame"), F.struct("conf", -F.col("frame"))).alias("r")).select("clip_id", "window", "track_id", "r.*")


def second_signal(candidates: DataFrame, best: DataFrame) -> DataFrame:
    """``candidates(clip_id, window, track_id, expected)`` against their best read."""
    rows = candidates.join(best, ["clip_id", "window", "track_id"], "left")
    outcome = (
        F.when(F.col("expected").isNull(), "no_position_hypothesis").when(F.col("number").isNull(), "no_confident_read")
        .when(F.col("number") == F.col("expected"), "agree").otherwise("disagree")
    )
    return rows.select("clip_id", "window", "track_id", "expected", "number", outcome.alias("outcome"))


def typed_labels(labels: DataFrame, rosters: DataFrame) -> DataFrame:
    """Number, ref, bench, spliced, none or refused, with a reason for refusals."""
    numbers = rosters.select("clip_id", F.col("number").cast("int").alias("number"), F.lit(True).alias("listed")).distinct()
    rows = labels.withColumn("number", F.col("label").try_cast("int")).join(numbers, ["clip_id", "number"], "left")
    kind = (
        F.when(F.col("label").isNull(), "none").when(F.col("label").isin("ref", "bench", "spliced"), F.col("label"))
        .when(F.col("listed"), "number").otherwise("refused")
    )
    why = F.when(kind == "refused", F.when(F.col("number").isNull(), "not a number").otherwise("off roster"))
    return rows.select("clip_id", "track_id", "label", kind.alias("kind"), F.when(kind == "number", F.col("number")).alias("number"), why.alias("reason"))


def dual_numbers(rosters: DataFrame) -> DataFrame:
    """Numbers that more than one team of a clip carries."""
    return rosters.groupBy("clip_id", "number").agg(F.countDistinct("team").alias("teams")).where("teams > 1")


CONFIRMED = ("confirmed", "confirmed_retroactive")
_IDENTITY = ["clip_id", "window", "identity_id"]


def named(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """The events with ``number``: that of their merge stamp, else the registry's for their identity, else null."""
    told = events.join(numbers.where("number is not null").select(*_IDENTITY, F.col("number").cast("long").alias("_registered")).hint("merge"), _IDENTITY, "left")
    stamp = F.col("merge.number").cast("long") if "merge" in events.columns else F.lit(None).cast("long")
    return told.withColumn("number", F.coalesce(stamp, "_registered")).drop("_registered")


def box_score(events: DataFrame, numbers: DataFrame, positions: DataFrame, fps: float = 30.0, length: float = 84.0, rosters: DataFrame | None = None, identity_teams: DataFrame | None = None) -> DataFrame:
    """Seconds of each number and team, live and retroactive, with zones.

    ``events(clip_id, window, frame, identity_id, track_id, state)`` and perhaps ``merge`` (U3), ``numbers(clip_id, window, identity_id,
    number)``, ``positions(clip_id, frame, track_id, court_x, court_y)`` of all bodies, ``rosters(clip_id, team, number)``,
    ``identity_teams(clip_id, window, identity_id, team)``, with ``number`` or without, for numbers of several teams. A merge stamp
    goes before the registry's number. Confirmed and retroactively confirmed frames count; frames that two identities claim for one
    number are disputed and not counted; frames without a position are counted apart. A number of several teams has a line for each
    team that its identities are told to be of and one AMBIGUOUS line, which takes the disputed frames; other numbers carry them on
    their only line. Numbers without a team are "off-roster?".
    """
    live = F.col("state") == "confirmed"
    credited = named(events.where(F.col("state").isin(*CONFIRMED)), numbers).where("number is not null")
    one = F.struct("window", "identity_id")
    frames = credited.groupBy("clip_id", "number", "frame").agg((F.min(one) != F.max(one)).alias("disputed"), F.min(F.struct("window", "identity_id", "track_id", live.alias("live"))).alias("c"))
    frames = frames.select("clip_id", "number", "frame", "disputed", "c.*")
    told = (rosters or numbers.select("clip_id", F.lit("").alias("team"), "number").limit(0)).groupBy("clip_id", F.col("number").cast("long").alias("number")).agg(F.array_sort(F.collect_set("team")).alias("teams"))
    frames = frames.join(told.hint("merge"), ["clip_id", "number"], "left")
    if identity_teams is None:
        frames = frames.withColumn("own", F.lit(None).cast("string"))
    else:
        key = [c for c in (*_IDENTITY, "number") if c in identity_teams.columns]
        frames = frames.join(identity_teams.select(*key, F.col("team").alias("own")).hint("merge"), key, "left")
    several = F.coalesce(F.size("teams") > 1, F.lit(False))
    doubt = F.concat(F.lit("AMBIGUOUS ("), F.array_join("teams", " / "), F.lit(")"))
    label = F.when(several, F.when(F.col("disputed"), doubt).otherwise(F.coalesce("own", doubt))).otherwise(F.coalesce(F.get("teams", F.lit(0)), F.lit("off-roster?")))
    placed = frames.withColumn("team", label).join(positions.select("clip_id", "frame", "track_id", "court_x", "court_y").hint("merge"), ["clip_id", "frame", "track_id"], "left")
    sole = ~F.col("disputed")
    zone = F.when(F.col("court_x").isNotNull(), zone_of("court_x", "court_y", length))
    by_zone = placed.withColumn("zone", zone).groupBy("clip_id", "number", "team", "zone").agg(
        F.count_if(sole & F.col("live")).alias("live"), F.count_if(sole & ~F.col("live")).alias("retro"), F.count_if(~sole).alias("disputed"),
        F.min(F.when(sole, F.col("frame"))).alias("first"), F.collect_set(F.when(sole, F.col("window"))).alias("windows"), F.max(several).alias("several"),
    )
    n = F.col("live") + F.col("retro")
    seen = n > 0
    lines = by_zone.groupBy("clip_id", "number", "team").agg(
        (F.sum("live") / fps).alias("seconds_live"), (F.sum("retro") / fps).alias("seconds_retro"), (F.sum(n) / fps).alias("seconds_total"), F.sum("disputed").alias("disputed_frames"), (F.sum("disputed") / fps).alias("disputed_seconds"),
        F.size(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows_present"),
        F.sum(F.when(F.col("zone").isNull(), n).otherwise(0)).alias("unpositioned_frames"),
        F.max_by("zone", F.when(F.col("zone").isNotNull() & seen, F.struct(n, -F.col("first")))).alias("top_zone"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("zone").isNotNull() & seen, F.struct("zone", (n / fps).alias("s")))))).alias("zone_seconds"),
        F.sum(n).alias("_n"), F.max("several").alias("_several"),
    )
    return lines.where("_n > 0 or _several").drop("_n", "_several")


def box_summary(events: DataFrame, numbers: DataFrame, oncourt: DataFrame, excluded: DataFrame, fps: float = 30.0) -> DataFrame:
    """A23's report by clip: confirmed identities without a number and their seconds, events that wait for review, and readable seconds:
    those of all bodies on court but ``excluded(clip_id, track_id)``, which named seconds are a share of."""
    told = named(events, numbers)
    nameless = F.col("state").isin(*CONFIRMED) & F.col("number").isNull()
    counts = told.groupBy("clip_id").agg(
        F.count_distinct(F.when(nameless, F.struct("window", "identity_id"))).alias("unnamed_identities"), (F.count_if(nameless) / fps).alias("unnamed_seconds"),
        F.count_if(F.col("state") == "candidate").alias("candidate_events"), F.count_if(F.col("state") == "unknown").alias("unknown_events"),
    )
    bodies = oncourt.where("is_on").join(excluded.select("clip_id", "track_id").distinct().hint("merge"), ["clip_id", "track_id"], "left_anti")
    readable = bodies.groupBy("clip_id").agg(F.bround(F.count(F.lit(1)) / fps, 1).alias("readable_seconds"))
    return counts.join(readable.hint("merge"), "clip_id", "full").fillna(0).fillna(0.0)


def tracking_coverage(lines: DataFrame, events: DataFrame, fps: float = 30.0) -> DataFrame:
    """Named and unnamed seconds and the named share; null where nothing is readable."""
    named = lines.groupBy("clip_id").agg(F.sum("seconds_total").alias("named_s"))
    readable = events.groupBy("clip_id").agg((F.count(F.lit(1)) / fps).alias("readable_s"))
    out = readable.join(named, "clip_id", "left").withColumn("named_s", F.coalesce("named_s", F.lit(0.0)))
    return out.withColumn("unnamed_s", F.col("readable_s") - F.col("named_s")).withColumn("pct", F.try_divide(100 * F.col("named_s"), F.col("readable_s")))
