"""The flagship plan: from tracks, positions, reads and labels to seconds per player and zone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.operators import audit, duals, identity, merge, resolutions, seeding, team
from courtflow.plans.tables import stored


def seeded_box_score(tracks: DataFrame, oncourt: DataFrame, size: int = 60, fps: float = 30.0) -> DataFrame:
    """I2, ST1, A23 over fixed windows: tracks on court at a window's first frame are seeds with number track * 7 mod 50."""
    placed = tracks.withColumn("window", team.fixed_window(size=size))
    votes = identity.on_court_vote(oncourt.withColumn("window", team.fixed_window(size=size))).where("on_court")
    first = placed.groupBy("clip_id", "window").agg(F.min("frame").alias("frame"))
    seeds = placed.join(first, ["clip_id", "window", "frame"], "left_semi").join(votes, ["clip_id", "window", "track_id"], "left_semi").select("clip_id", "window", "track_id")
    events = stored(identity.with_identity_ids(identity.identity_runs(placed, seeds)))
    numbers = events.where("run = 0").join(seeds, ["clip_id", "window", "track_id"], "left_semi").select("clip_id", "window", "identity_id", (F.col("track_id") * 7 % 50).alias("number")).distinct()
    return identity.box_score(events, numbers, oncourt, fps)


@dataclass(frozen=True)
class Identities:
    """What the plan knows of a run: events (ST1), the registry (J3), seeds (I2, W7), excluded tracks (U1), what second signals said."""

    events: DataFrame
    registry: DataFrame
    seeds: DataFrame
    excluded: DataFrame
    outcomes: DataFrame


def possession_starts(oncourt: DataFrame, fps: float, size: int = 60) -> DataFrame:
    """W5 from positions: where the windows of each clip start."""
    frames = stored(team.frame_means(oncourt, F.col("is_on")))  # a row a frame; possessions read it several times
    spans = frames.groupBy("clip_id").agg(F.min("frame").alias("span_start"), F.max("frame").alias("span_end"))
    return team.possession_windows(stored(team.possessions_v2(frames, fps)), spans, size)


def _seeded(tracks: DataFrame, oncourt: DataFrame, reads: DataFrame, typed: DataFrame, fps: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    starts = stored(possession_starts(oncourt, fps))
    placed = stored(team.window_of(tracks, starts))
    votes = identity.on_court_vote(team.window_of(oncourt, starts))
    spliced = identity.purity(reads).where("verdict = 'spliced'").select("clip_id", "track_id")
    excluded = stored(audit.excluded_tracks(typed, spliced))
    return placed, seeding.seeds(placed, votes, typed, excluded), excluded


def window_seeds(tracks: DataFrame, oncourt: DataFrame, reads: DataFrame, labels: DataFrame, rosters: DataFrame, fps: float = 30.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks with their possession windows, the seeds of each window (I2, W7), and the tracks that are none."""
    return _seeded(tracks, oncourt, reads, stored(identity.typed_labels(labels, rosters)), fps)


def identify(tracks: DataFrame, oncourt: DataFrame, reads: DataFrame, labels: DataFrame, rosters: DataFrame, fps: float = 30.0) -> Identities:
    """W5, A8, P19, A16, U1, I2, W7, ST1, J3, A18 and I3 over all clips at once.

    Windows start with possessions. Tracks on court at a window's start are trusted, labelled ones from their first appearance on;
    referees, the bench and tracks spliced by a person or by their reads are not. Placed tracks and events are written once, as all that
    follows reads them.
    """
    typed = stored(identity.typed_labels(labels, rosters))
    placed, given, excluded = _seeded(tracks, oncourt, reads, typed, fps)
    given = stored(given)
    events = stored(identity.with_identity_ids(identity.identity_runs(placed, given)))
    registry = stored(seeding.registry(events, given, typed))
    return Identities(events, registry, given, excluded, seeding.outcomes(registry, seeding.identity_reads(events, reads)))


def credited(run: Identities, resolved: DataFrame | None = None) -> DataFrame:
    """The run's events with the spans of candidates that a read agrees with, or a person resolved (I6), credited after the fact."""
    triggers = seeding.agree_triggers(run.outcomes)
    if resolved is not None:
        triggers = triggers.unionByName(resolutions.human_triggers(resolved))
    verdicts = merge.merge_verdicts(run.events, run.registry.where("number is not null"), stored(triggers))
    return merge.merged_events(run.events, stored(verdicts))


def named_box_score(tracks: DataFrame, oncourt: DataFrame, reads: DataFrame, labels: DataFrame, rosters: DataFrame, crops: DataFrame, fps: float = 30.0) -> DataFrame:
    """The jersey-keyed box score (A23) of ``identify``'s run with merges (U3) and teams of shared numbers by colour."""
    run = identify(tracks, oncourt, reads, labels, rosters, fps)
    events = stored(credited(run))
    return identity.box_score(events, run.registry, oncourt, fps, rosters=rosters, identity_teams=duals.dual_teams(events, run.registry, rosters, crops))


def relink_audit(tracks: DataFrame, starts: DataFrame) -> DataFrame:
    """(clip_id, cut, relinks, ambiguous, leaks): what windows contain.

    One machine a clip, without windows, relinks some tracks across where windows start: ``cut``. With windows such relinks can't be:
    ``leaks`` counts those that reach out of their window, and ``relinks`` and ``ambiguous`` what windows still have.
    """
    placed = team.window_of(tracks, starts)
    marks = stored(placed.select("clip_id", "frame", F.col("window").alias("_at")).distinct())
    lost = marks.select("clip_id", F.col("frame").alias("_from"), F.col("_at").alias("_lost"))

    def relinks(rows: DataFrame) -> DataFrame:
        back = rows.where("reason = 'relinked'").withColumn("_from", F.col("frame") - F.col("gap_frames"))
        return back.join(lost.hint("merge"), ["clip_id", "_from"]).join(marks.hint("merge"), ["clip_id", "frame"])

    free = relinks(identity.identity_runs(placed.withColumn("window", F.lit(0).cast("long"))))
    cut = free.groupBy("clip_id").agg(F.count_if(F.col("_lost") != F.col("_at")).alias("cut"))
    kept = stored(identity.identity_runs(placed))
    inside = relinks(kept).groupBy("clip_id").agg(F.count(F.lit(1)).alias("relinks"), F.count_if(F.col("_lost") != F.col("_at")).alias("leaks"))
    doubt = kept.where("reason = 'ambiguous reappearance'").groupBy("clip_id").agg(F.count(F.lit(1)).alias("ambiguous"))
    out = tracks.select("clip_id").distinct()
    for table in (cut, inside, doubt):
        out = out.join(table.hint("merge"), "clip_id", "left")
    return out.fillna(0).select("clip_id", "cut", "relinks", "ambiguous", "leaks")
