"""People's resolutions of review items: which may be applied to this run, and as what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_clips(resolutions: DataFrame, starts: DataFrame) -> DataFrame:
    """Clips whose resolutions were made against other windows: (clip_id, made_against, current).

    ``resolutions(clip_id, made_against array<long>, ...)``; null means that the file does not tell, which refuses nothing.
    ``starts(clip_id, start)`` of the current windows; a clip without windows is not held against any.
    """
    now = starts.groupBy("clip_id").agg(F.array_sort(F.collect_set("start")).alias("current"))
    made = resolutions.where("made_against is not null").select("clip_id", "made_against").distinct()
    return made.join(now.hint("merge"), "clip_id").where(F.array_sort("made_against") != F.col("current")).select("clip_id", "made_against", "current")


def checked(resolutions: DataFrame, starts: DataFrame, rosters: DataFrame, events: DataFrame) -> DataFrame:
    """Every resolution with ``status`` applied or refused and the ``reason``; those applied with the identity of this run.

    ``resolutions(clip_id, window, track_id, number string, needs_review string, made_against)``, with ``ord``, their order in the file.
    Rules, the first that holds decides: one stale boundary refuses the whole clip; a note that asks for review; a number that is
    no "reject" and not on the clip's roster; no track; a track that the window lacks. Resolutions go by track: ``identity_id`` is the
    one that the track has last in the window (``events(clip_id, window, frame, track_id, identity_id)``).
    """
    stale = stale_clips(resolutions, starts).select("clip_id").distinct().withColumn("_stale", F.lit(True))
    listed = rosters.select("clip_id", F.col("number").cast("string").alias("number"), F.lit(True).alias("_listed")).distinct()
    last = events.groupBy("clip_id", "window", "track_id").agg(F.max_by("identity_id", F.struct("frame", "identity_id")).alias("_identity"))
    rows = resolutions.join(stale.hint("merge"), "clip_id", "left").join(listed.hint("merge"), ["clip_id", "number"], "left")
    rows = rows.join(last.hint("merge"), ["clip_id", "window", "track_id"], "left")
    reason = (
        F.when(F.col("_stale"), "windows have moved").when(F.col("needs_review").isNotNull(), F.concat(F.lit("needs review: "), F.col("needs_review")))
        .when(F.col("number").isNull() | ((F.col("number") != "reject") & F.col("_listed").isNull()), "off roster")
        .when(F.col("track_id").isNull(), "no track").when(F.col("_identity").isNull(), "track not in the window")
    )
    told = rows.withColumn("reason", reason)
    return told.select("clip_id", "window", "track_id", "number", "ord", F.when(F.col("reason").isNull(), F.col("_identity")).alias("identity_id"), F.when(F.col("reason").isNull(), "applied").otherwise("refused").alias("status"), "reason")


def human_triggers(told: DataFrame) -> DataFrame:
    """The merge triggers (U3) of applied resolutions; "reject" has no number."""
    number = F.col("number").try_cast("long")
    return told.where("status = 'applied'").select("clip_id", "window", "identity_id", number.alias("number"), F.lit("human").alias("source"), F.col("ord").cast("long").alias("ord"))


def rekeyed_file(resolutions: DataFrame, events: DataFrame) -> DataFrame:
    """Resolutions that were filed under an identity, filed under its track: (..., track_id, needs_review, status).

    Those that have a track stay as they are. Where the identity of the run they were made on has one track, that is it; several
    tracks, or none, leave the row without a track and with a note that asks for review. ``events`` must be those of that run.
    """
    tracks = events.groupBy("clip_id", "window", "identity_id").agg(F.count_distinct("track_id").alias("_n"), F.min("track_id").alias("_track"))
    met = resolutions.join(tracks.hint("merge"), ["clip_id", "window", "identity_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    kept = F.col("track_id").isNotNull()
    status = F.when(kept, "kept").when(F.col("_n") == 1, "migrated").when(F.col("_n") > 1, "ambiguous").otherwise("not_found")
    note = F.when(status.isin("ambiguous", "not_found"), F.when(F.col("_n") > 1, F.format_string("identity spans %d tracks", "_n")).otherwise("identity is not in the run")).otherwise(F.col("needs_review"))
    others = [c for c in resolutions.columns if c not in ("track_id", "needs_review")]
    return met.select(*others, F.when(kept, F.col("track_id")).when(F.col("_n") == 1, F.col("_track")).alias("track_id"), note.alias("needs_review"), status.alias("status"))
