"""What a clip's tables say, as one nested document a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.functions.exprs import shot_zone
from courtflow.operators.reports import is_ambiguous
from courtflow.operators.shots import distribution
from courtflow.sources.documents import TEAM_DOC_VERSION

_LINES = ["number", "team", "seconds_total", "seconds_live", "seconds_retro", "windows_present", "zone_seconds", "top_zone", "disputed_seconds", "ambiguous"]
_SHOTS = ["start_frame", "end_frame", "court_x", "court_y", "zone", "dist_ft", "shot_type", "hoop", "shooter_status"]


def _list(fields: list[str], *order) -> Column:
    """The group's rows as an array of structs, in order."""
    keys = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    return F.transform(F.array_sort(F.collect_list(F.struct(keys.alias("o"), F.struct(*fields).alias("v")))), lambda x: x["v"])


def located_shots(locations: DataFrame, attempts: DataFrame, length: float = 84.0) -> DataFrame:
    """Located shots with zone, distance, type and hoop; attempts of the same start and end that are no shots tell neither."""
    spans = ["clip_id", "start_frame", "end_frame"]
    told = attempts.where("verdict = 'shot_attempt'").groupBy(*spans).agg(F.min(F.struct("shot_type", "hoop")).alias("a"))
    zone, dist = shot_zone("court_x", "court_y", length)
    met = locations.where("status = 'located'").join(told.hint("merge"), spans, "left")
    return met.select(*spans, "court_x", "court_y", zone.alias("zone"), F.bround(dist, 1).alias("dist_ft"), F.col("a.shot_type").alias("shot_type"), F.col("a.hoop").alias("hoop"), "shooter_status")


def measured_stats(lines: DataFrame, summary: DataFrame, locations: DataFrame, attempts: DataFrame, length: float = 84.0, touches: DataFrame | None = None, touch_summary: DataFrame | None = None) -> DataFrame:
    """H8: (clip_id, doc): the bundle of each clip of ``summary``.

    ``lines`` (A23), ``summary`` (``identity.box_summary``), ``locations(clip_id, start_frame, end_frame, status, court_x, court_y,
    shooter_status)``, ``attempts(clip_id, start_frame, end_frame, verdict, shot_type, hoop)``, touches and their summary (ST6, A35) where
    there are any. Named seconds are a share of readable ones, null where nothing is readable; makes and misses are not told by design.
    """
    box = lines.withColumn("ambiguous", is_ambiguous(F.col("team"))).withColumn("zone_seconds", F.to_json("zone_seconds"))
    box = box.groupBy("clip_id").agg(_list(_LINES, -F.col("seconds_total"), F.col("number"), F.col("team")).alias("box_score"), F.sum("seconds_total").alias("_named"))
    spots = located_shots(locations, attempts, length)
    shots = spots.groupBy("clip_id").agg(_list(_SHOTS, F.col("start_frame"), F.col("end_frame")).alias("shots"))
    lost = locations.groupBy("clip_id").agg(F.count_if(F.col("status") != "located").alias("shots_unlocated"))
    spread = distribution(spots.select("clip_id", "zone")).select("clip_id", F.struct("n", "three", "midrange", "paint", "pct_three", "pct_two").alias("shot_distribution"))
    out = summary
    tables = [box, shots, lost, spread]
    if touches is not None and touch_summary is not None:
        kept = ["track_id", "start_frame", "end_frame", "number", "status", "observed_seconds", "inferred_seconds", "total_seconds", "court_x", "court_y"]
        tables.append(touches.groupBy("clip_id").agg(_list(kept, F.col("start_frame")).alias("touches")))
        tables.append(touch_summary.select("clip_id", F.struct(*(c for c in touch_summary.columns if c != "clip_id")).alias("touch_summary")))
    for table in tables:
        out = out.join(table.hint("merge"), "clip_id", "left")
    named = F.coalesce("_named", F.lit(0.0))
    court = F.struct(F.lit(length).alias("length_ft"), F.lit(50.0).alias("width_ft"), F.lit(5.25).alias("hoop_dx_ft"), F.lit(19.75).alias("three_radius_ft"))
    tracking = F.struct(
        F.bround(named, 1).alias("named_seconds"), F.bround("unnamed_seconds", 1).alias("unnamed_seconds"), "unnamed_identities", "readable_seconds",
        F.when(F.col("readable_seconds") > 0, F.bround(100 * named / F.col("readable_seconds"), 1)).alias("pct_of_readable_named"), F.struct("candidate_events", "unknown_events").alias("review_backlog"),
    )
    meta = F.struct(F.lit(False).alias("make_miss_available"), F.lit(touches is not None).alias("touches_available"), court.alias("court"))
    fields = [F.col("clip_id").cast("string").alias("clip"), meta.alias("meta"), tracking.alias("tracking"), "box_score", "shots", F.coalesce("shots_unlocated", F.lit(0).cast("long")).alias("shots_unlocated"), "shot_distribution"]
    fields += ["touches", "touch_summary"] if len(tables) > 4 else []
    return out.select("clip_id", F.struct(*fields).alias("doc"))


def team_document(events: DataFrame, heatmap: DataFrame, stats: DataFrame, meta: DataFrame, fps: float = 30.0) -> DataFrame:
    """(clip_id, doc): the team layer's contract. ``events(clip_id, start, ...)`` are approximate by nature and say so; ``heatmap(clip_id, team,
    court_x, court_y)``; ``stats`` and ``meta`` have a row a clip. Later layers add keys beside these."""
    inner = [c for c in events.columns if c != "clip_id"]
    told = events.withColumn("approx", F.lit(True)).groupBy("clip_id").agg(_list([*inner, "approx"], F.col("start")).alias("team_events"))
    spots = heatmap.groupBy("clip_id", "team").agg(F.array_sort(F.collect_list(F.array("court_x", "court_y"))).alias("p"))
    maps = spots.groupBy("clip_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("team", "p")))).alias("heatmap_data"))
    one = lambda t, name: t.select("clip_id", F.struct(*(c for c in t.columns if c != "clip_id")).alias(name))
    out = one(meta, "meta")
    for table in (told, maps, one(stats, "team_stats")):
        out = out.join(table.hint("merge"), "clip_id", "left")
    doc = F.struct(F.lit(TEAM_DOC_VERSION).alias("schema_version"), F.col("clip_id").cast("string").alias("game_id"), F.lit(fps).alias("fps"), F.lit(True).alias("court_calibrated"), "team_events", "heatmap_data", "team_stats", "meta")
    return out.select("clip_id", doc.alias("doc"))


def write_bundles(bundles: DataFrame, path: str) -> None:
    """A folder a clip, a document a line."""
    bundles.select("clip_id", F.to_json("doc", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy("clip_id").text(path)


def read_bundles(spark, path: str, bundle: DataFrame) -> DataFrame:
    """The documents again, with the schema of ``bundle``'s."""
    return spark.read.text(path).select(F.from_json("value", bundle.schema["doc"].dataType).alias("doc")).select(F.col("doc"))
