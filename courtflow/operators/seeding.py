"""Which tracks a window trusts from the start, and what becomes of candidates when a second signal speaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.operators.identity import CONFIDENT

_TRACK = ["clip_id", "window", "track_id"]
_IDENTITY = ["clip_id", "window", "identity_id"]


def seeds(tracks: DataFrame, votes: DataFrame, typed: DataFrame, excluded: DataFrame) -> DataFrame:
    """(clip_id, window, track_id, reason): tracks whose first identity of a window is confirmed.

    ``tracks(clip_id, window, frame, track_id)``, ``votes`` (A8), ``typed`` labels (P19), ``excluded`` tracks (U1). A track on court in
    its window's first frame is a "seed". One that appears later is a "late seed" if its label is a number: the label vouches for the
    body from its first frame on. Excluded tracks are neither. A track's first identity in a window is always a fresh one, so what
    was relinked can't be seeded; ST1 confirms first identities only.
    """
    on = votes.where("on_court").select(*_TRACK)
    numbered = typed.where("kind = 'number'").select("clip_id", "track_id", F.lit(True).alias("_numbered")).distinct()
    firsts = tracks.where("track_id is not null").groupBy(*_TRACK).agg(F.min("frame").alias("_f"))
    frames = tracks.groupBy("clip_id", "window").agg(F.min("frame").alias("_start"))  # a frame without tracks starts a window as well
    kept = firsts.join(frames.hint("merge"), ["clip_id", "window"]).join(on.hint("merge"), _TRACK, "left_semi")
    kept = kept.join(excluded.select("clip_id", "track_id").distinct().hint("merge"), ["clip_id", "track_id"], "left_anti").join(numbered.hint("merge"), ["clip_id", "track_id"], "left")
    reason = F.when(F.col("_f") == F.col("_start"), "seed").when(F.col("_numbered"), "late seed")
    return kept.select(*_TRACK, reason.alias("reason")).where("reason is not null")


def unmatched_seeds(given: DataFrame, tracks: DataFrame) -> DataFrame:
    """Seeds for tracks that their window does not have: they confirm nothing and are told, never lost in silence."""
    there = tracks.select(*_TRACK).distinct()
    return given.select(*_TRACK).distinct().join(there.hint("merge"), _TRACK, "left_anti").withColumn("why", F.lit("no such track in the window"))


def registry(events: DataFrame, given: DataFrame, typed: DataFrame) -> DataFrame:
    """A row an identity: (clip_id, window, identity_id, track_id, number, final_state, ever_candidate).

    ``events`` (ST1 with identity ids); the number is that of the label of the track whose seed made the identity, else null.
    """
    last = events.groupBy(*_IDENTITY, "track_id").agg(F.min("run").alias("run"), F.max_by("state", "frame").alias("final_state"), F.bool_or(F.col("state") == "candidate").alias("ever_candidate"))
    numbers = typed.where("kind = 'number'").groupBy("clip_id", "track_id").agg(F.min("number").cast("long").alias("_n"))
    seeded = given.select(*_TRACK, F.lit(True).alias("_seeded")).distinct()
    met = last.join(seeded.hint("merge"), _TRACK, "left").join(numbers.hint("merge"), ["clip_id", "track_id"], "left")
    number = F.when((F.col("run") == 0) & F.col("_seeded"), F.col("_n"))
    return met.select(*_IDENTITY, "track_id", number.alias("number"), "final_state", "ever_candidate")


def identity_reads(events: DataFrame, reads: DataFrame) -> DataFrame:
    """A18 by identity: the best confident read among the frames of each identity; the earliest frame wins a tie."""
    at = events.select(*_IDENTITY, "track_id", "frame")
    met = reads.where(F.col("conf") >= CONFIDENT).join(at.hint("merge"), ["clip_id", "track_id", "frame"])
    best = met.groupBy(*_IDENTITY).agg(F.max_by(F.struct("number", "conf", "frame"), F.struct("conf", -F.col("frame"), "number")).alias("r"))
    return best.select(*_IDENTITY, F.col("r.number").alias("number"), F.col("r.conf").alias("conf"), F.col("r.frame").alias("frame"))


def outcomes(identities: DataFrame, best: DataFrame) -> DataFrame:
    """I3 for every identity that was a candidate and is not confirmed: agree, disagree, no_confident_read or no_position_hypothesis.

    ``identities`` as ``registry`` gives them, ``best`` as ``identity_reads`` does. (clip_id, window, identity_id, expected, number, conf,
    frame, outcome)
    """
    asked = identities.where("ever_candidate and final_state <> 'confirmed'").select(*_IDENTITY, F.col("number").alias("expected"))
    met = asked.join(best.hint("merge"), _IDENTITY, "left")
    told = F.when(F.col("number").isNull(), "no_confident_read").when(F.col("expected").isNull(), "no_position_hypothesis").when(F.col("number") == F.col("expected"), "agree").otherwise("disagree")
    return met.select(*_IDENTITY, "expected", "number", "conf", "frame", told.alias("outcome"))


def agree_triggers(told: DataFrame) -> DataFrame:
    """The merge triggers (U3) of agreeing reads, in the order of identities."""
    order = F.row_number().over(Window.partitionBy("clip_id", "window").orderBy("identity_id"))
    return told.where("outcome = 'agree'").select(*_IDENTITY, F.col("number").cast("long").alias("number"), F.lit("ocr").alias("source"), order.cast("long").alias("ord"))


def review_items(events: DataFrame) -> DataFrame:
    """(clip_id, window, identity_id, track_id, state, frame, why, rank): identities that end as candidates or unknown.

    ``events`` as ST1 gives them, with identity ids. A candidate is shown where it last reappeared, with its gap and its distance from
    where it was expected; another one at the first of its last five frames, with the reason why it is new. In the order of T2.
    """
    recent = F.row_number().over(Window.partitionBy(*_IDENTITY).orderBy(F.desc("frame")))
    rows = events.withColumn("_r", recent)
    relink = F.max_by(F.struct("frame", "gap_frames", "distance_px"), F.when(F.col("reason") == "relinked", F.col("frame")))
    last = rows.groupBy(*_IDENTITY, "track_id").agg(
        F.max_by("state", "frame").alias("state"), relink.alias("_back"), F.min(F.when(F.col("_r") <= 5, F.col("frame"))).alias("_recent"), F.min_by("reason", "frame").alias("_first"),
    ).where("state in ('candidate', 'unknown')")
    candidate = F.col("state") == "candidate"
    why = F.when(candidate, F.format_string("candidate: back after %d frames, %.1f px from where motion would have it; no second signal", "_back.gap_frames", "_back.distance_px")).otherwise(F.concat(F.lit("unknown: "), F.col("_first")))
    out = last.select(*_IDENTITY, "track_id", "state", F.when(candidate, F.col("_back.frame")).otherwise(F.col("_recent")).alias("frame"), why.alias("why"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("clip_id").orderBy("window", "frame", "track_id", "identity_id")))
