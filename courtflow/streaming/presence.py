"""Structured Streaming versions of occupancy and presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.functions.exprs import zone_of


def windowed_zones(positions: DataFrame, width: str = "2 seconds", late: str = "5 seconds") -> DataFrame:
    """ST9: bodies of each zone in tumbling windows of event time ``ts``; rows later than ``late`` are dropped."""
    rows = positions.withWatermark("ts", late)
    return rows.groupBy("clip_id", F.window("ts", width), zone_of("court_x", "court_y").alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def presence_sessions(tracks: DataFrame, gap: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """ST10: presence of each track as sessions that end after ``gap`` of silence."""
    rows = tracks.withWatermark("ts", late)
    return rows.groupBy("clip_id", "track_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(rows: DataFrame, late: str = "5 seconds") -> DataFrame:
    """ST11: each (clip, frame, track) once within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["clip_id", "frame", "track_id"])
