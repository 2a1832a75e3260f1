"""The engine's other artifacts: one nested JSON document a clip, read into flat rows and written from them.

A document read with ``lines=False`` is a file of its own, as people and other tools write them; written ones have a line each, so
that a folder of them is read and written in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions of the two contracts that have one (fixed values).
TEAM_EVENT_VERSION, TEAM_DOC_VERSION = "team_event.v1", 1

_XY = "array<double>"
TEAM_EVENTS = f"schema_version string, clip string, fps double, frames array<struct<frame_index: long, timestamp_s: double, homography_confidence: struct<inliers: long, reproj_px: double, state: string, nearest_keyframe: long>, detections: array<struct<pixel: {_XY}, court_feet: {_XY}, identity_state: string, team: string>>, schema_version: string>>"
ARCS = "clip string, span_start long, span_len long, fps double, chains array<struct<points: array<array<double>>, verdict: string, arcs: array<struct<start_frame: long, end_frame: long, n_points: long, accel_y: double, accel_x: double, rms: double>>>>"
OUTCOMES = "clip string, window_boundaries array<long>, outcomes map<string, array<struct<window: long, identity_id: long, track_id: long, position_hypothesis: long, final_state: string, read_number: long, read_confidence: double, read_frame: long>>>, identities array<struct<window: long, identity_id: long, track_id: long, roster_number: long, final_state: string>>"
RESOLUTIONS = "clip string, window_boundaries array<long>, queue_resolutions array<struct<window: long, identity_id: long, track_id: long, number: string, needs_review: string>>"
PURITY = "clip string, tracks map<string, struct<verdict: string, attempts: long, interleaved: boolean, splice_interval: array<long>>>"
CONFIG = "name string, tracking_span_start long, tracking_span_len long, ball_span_start long, ball_span_len long, accumulation_window_seconds double, teams array<struct<name: string, color: string, numbers: array<long>>>, seed_labels map<string, long>, hoop_anchors map<string, struct<keyframe: long, pixel: array<double>>>"
POSSESSIONS = "clip string, fps double, possessions array<struct<side: string, start: long, `end`: long, side_agreement: double>>, boundaries array<long>"
SCOREBOARD = "clip string, sample_stride long, readings array<struct<frame: long, home: long, away: long>>, events array<struct<frame: long, from_home: long, from_away: long, to_home: long, to_away: long>>"
LANDMARKS = "clip string, landmarks map<string, array<struct<tag: string, x: double, y: double>>>"


def read_documents(spark: SparkSession, path: str | Sequence[str], schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path if isinstance(path, str) else list(path))


def write_documents(docs: DataFrame, path: str) -> None:
    """A line a document; nulls are kept, so that a reader sees them as such."""
    docs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _items(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row an element of an array of structs."""
    return docs.select(F.col("clip").alias("clip_id"), *keep, F.explode(column).alias("_e")).select("clip_id", *keep, "_e.*")


def _gathered(rows: DataFrame, fields: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """One array of structs a clip, in order."""
    at = F.struct(*order)
    kept = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.struct(*fields).alias("v")))), lambda x: x["v"])
    return rows.groupBy("clip_id").agg(kept.alias(name))


def team_events(docs: DataFrame) -> DataFrame:
    """A row a detection: (clip_id, frame, timestamp_s, inliers, reproj_px, confidence, nearest_keyframe, det_idx, px, py, court_x, court_y,
    identity_state, team); a frame without detections keeps a row of nulls. States and teams that are not told are "unknown"."""
    rows = docs.select(F.col("clip").alias("clip_id"), F.explode("frames").alias("f")).select("clip_id", "f.frame_index", "f.timestamp_s", "f.homography_confidence", F.posexplode_outer("f.detections").alias("det_idx", "d"))
    at = lambda c, i: F.get(f"d.{c}", F.lit(i))
    known = lambda c: F.when(F.col("d").isNotNull(), F.coalesce(f"d.{c}", F.lit("unknown"))).alias(c)
    return rows.select("clip_id", F.col("frame_index").alias("frame"), "timestamp_s", F.col("homography_confidence.inliers").alias("inliers"), F.col("homography_confidence.reproj_px").alias("reproj_px"), F.col("homography_confidence.state").alias("confidence"),
        F.col("homography_confidence.nearest_keyframe").alias("nearest_keyframe"), "det_idx", at("pixel", 0).alias("px"), at("pixel", 1).alias("py"), at("court_feet", 0).alias("court_x"), at("court_feet", 1).alias("court_y"), known("identity_state"), known("team"))


def team_event_documents(rows: DataFrame, fps: float = 30.0) -> DataFrame:
    """Documents (``TEAM_EVENTS``) from rows as ``team_events`` gives them."""
    version = F.lit(TEAM_EVENT_VERSION).alias("schema_version")
    det = F.struct(F.array("px", "py").alias("pixel"), F.array("court_x", "court_y").alias("court_feet"), "identity_state", "team")
    there = F.col("det_idx").isNotNull()
    dets = F.transform(F.array_sort(F.collect_list(F.when(there, F.struct("det_idx", det.alias("v"))))), lambda x: x["v"])
    frames = rows.groupBy("clip_id", F.col("frame").alias("frame_index"), "timestamp_s", "inliers", "reproj_px", "confidence", "nearest_keyframe").agg(dets.alias("detections"))
    frames = frames.withColumn("homography_confidence", F.struct("inliers", "reproj_px", F.col("confidence").alias("state"), "nearest_keyframe")).withColumn("schema_version", version)
    out = _gathered(frames, ["frame_index", "timestamp_s", "homography_confidence", "detections", "schema_version"], ["frame_index"], "frames")
    return out.select(version, F.col("clip_id").cast("string").alias("clip"), F.lit(fps).alias("fps"), "frames")


def arc_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clip_id, chain, frame, cx, cy) of all chains, and (clip_id, chain, verdict, arc, start_frame, ...) with a row an arc, or one of nulls."""
    chains = docs.select(F.col("clip").alias("clip_id"), F.posexplode("chains").alias("chain", "c"))
    at = lambda i: F.get("p", F.lit(i))
    points = chains.select("clip_id", "chain", F.explode("c.points").alias("p")).select("clip_id", "chain", at(0).cast("long").alias("frame"), at(1).alias("cx"), at(2).alias("cy"))
    arcs = chains.select("clip_id", "chain", "c.verdict", F.posexplode_outer("c.arcs").alias("arc", "a")).select("clip_id", "chain", "verdict", "arc", "a.*")
    return points, arcs


def outcome_rows(docs: DataFrame) -> DataFrame:
    """A row an outcome: (clip_id, outcome, window, identity_id, track_id, position_hypothesis, final_state, read_number, read_confidence, read_frame)."""
    return docs.select(F.col("clip").alias("clip_id"), F.explode("outcomes").alias("outcome", "rows")).select("clip_id", "outcome", F.explode("rows").alias("r")).select("clip_id", "outcome", "r.*")


def identity_rows(docs: DataFrame) -> DataFrame:
    """The registry of all identities: (clip_id, window, identity_id, track_id, number, final_state)."""
    return _items(docs, "identities").withColumnRenamed("roster_number", "number")


def outcome_documents(outcomes: DataFrame, identities: DataFrame, starts: DataFrame) -> DataFrame:
    """Documents (``OUTCOMES``) from outcomes and the registry as the readers give them, and ``starts(clip_id, start)`` of the windows."""
    fields = ["window", "identity_id", "track_id", "position_hypothesis", "final_state", "read_number", "read_confidence", "read_frame"]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct("window", "identity_id").alias("o"), F.struct(*fields).alias("v")))), lambda x: x["v"])
    told = outcomes.groupBy("clip_id", "outcome").agg(rows.alias("rows")).groupBy("clip_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "rows")))).alias("outcomes"))
    known = _gathered(identities.withColumnRenamed("number", "roster_number"), ["window", "identity_id", "track_id", "roster_number", "final_state"], ["window", "identity_id"], "identities")
    windows = starts.groupBy("clip_id").agg(F.array_sort(F.collect_set("start")).alias("window_boundaries"))
    return known.join(told.hint("merge"), "clip_id", "full").join(windows.hint("merge"), "clip_id", "left").select(F.col("clip_id").cast("string").alias("clip"), "window_boundaries", "outcomes", "identities")


def resolution_rows(docs: DataFrame) -> DataFrame:
    """people's resolutions in the order of the file, as ``resolutions.checked`` takes them; a document without any has no rows."""
    rows = docs.select(F.col("clip").alias("clip_id"), F.col("window_boundaries").alias("made_against"), F.posexplode("queue_resolutions").alias("ord", "r"))
    return rows.select("clip_id", "r.window", "r.identity_id", "r.track_id", "r.number", "r.needs_review", "made_against", F.col("ord").cast("long").alias("ord"))


def purity_rows(docs: DataFrame) -> DataFrame:
    """(clip_id, track_id, verdict, attempts, interleaved, splice_from, splice_to); a clip without a document has no evidence, which is not clean."""
    rows = docs.select(F.col("clip").alias("clip_id"), F.explode("tracks").alias("track_id", "v"))
    ends = [F.get("v.splice_interval", F.lit(i)).alias(n) for i, n in enumerate(("splice_from", "splice_to"))]
    return rows.select("clip_id", F.col("track_id").cast("long").alias("track_id"), "v.verdict", "v.attempts", "v.interleaved", *ends)


def purity_documents(rows: DataFrame) -> DataFrame:
    """Documents (``PURITY``) from rows as ``purity_rows`` gives them."""
    interval = F.when(F.col("splice_from").isNotNull(), F.array("splice_from", "splice_to")).alias("splice_interval")
    entry = F.struct(F.col("track_id").cast("string"), F.struct("verdict", F.col("attempts").cast("long").alias("attempts"), "interleaved", interval))
    return rows.groupBy(F.col("clip_id").cast("string").alias("clip")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tracks"))


def config_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips with their spans, rosters (clip_id, team, color, number), and hoop anchors (clip_id, hoop, keyframe, px, py)."""
    named = docs.withColumnRenamed("name", "clip_id")
    clips = named.select("clip_id", "tracking_span_start", "tracking_span_len", "ball_span_start", "ball_span_len", "accumulation_window_seconds")
    rosters = named.select("clip_id", F.explode("teams").alias("t")).select("clip_id", F.col("t.name").alias("team"), F.col("t.color").alias("color"), F.explode("t.numbers").alias("number"))
    anchors = named.select("clip_id", F.explode("hoop_anchors").alias("hoop", "a")).select("clip_id", "hoop", "a.keyframe", F.get("a.pixel", F.lit(0)).alias("px"), F.get("a.pixel", F.lit(1)).alias("py"))
    return clips, rosters, anchors


def possession_rows(docs: DataFrame) -> DataFrame:
    """(clip_id, side, start, end, side_agreement)."""
    return _items(docs, "possessions")


def possession_documents(rows: DataFrame, starts: DataFrame, fps: float = 30.0) -> DataFrame:
    """Documents (``POSSESSIONS``) from W4 and the starts of W5."""
    segments = _gathered(rows, ["side", "start", "end", "side_agreement"], ["start"], "possessions")
    windows = starts.groupBy("clip_id").agg(F.array_sort(F.collect_set("start")).alias("boundaries"))
    return segments.join(windows.hint("merge"), "clip_id", "full").select(F.col("clip_id").cast("string").alias("clip"), F.lit(fps).alias("fps"), "possessions", "boundaries")


def scoreboard_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings (clip_id, frame, home, away) for ST7, and events as it gives them."""
    return _items(docs, "readings"), _items(docs, "events")


def scoreboard_documents(readings: DataFrame, events: DataFrame, stride: int) -> DataFrame:
    """Documents (``SCOREBOARD``); a clip without events has none in an empty list."""
    seen = _gathered(readings, ["frame", "home", "away"], ["frame"], "readings")
    told = _gathered(events, ["frame", "from_home", "from_away", "to_home", "to_away"], ["frame"], "events")
    none = F.array().cast("array<struct<frame:bigint,from_home:bigint,from_away:bigint,to_home:bigint,to_away:bigint>>")
    met = seen.join(told.hint("merge"), "clip_id", "left")
    return met.select(F.col("clip_id").cast("string").alias("clip"), F.lit(stride).cast("long").alias("sample_stride"), "readings", F.coalesce("events", none).alias("events"))


def landmark_rows(docs: DataFrame) -> DataFrame:
    """(clip_id, keyframe, tag, px, py)."""
    rows = docs.select(F.col("clip").alias("clip_id"), F.explode("landmarks").alias("keyframe", "m")).select("clip_id", F.col("keyframe").cast("long").alias("keyframe"), F.explode("m").alias("m"))
    return rows.select("clip_id", "keyframe", "m.tag", F.col("m.x").alias("px"), F.col("m.y").alias("py"))


def write_events(events: DataFrame, path: str) -> None:
    """Identity events as a fact table, a folder a clip."""
    events.repartition("clip_id").sortWithinPartitions("window", "frame", "identity_id").write.mode("overwrite").partitionBy("clip_id").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events, with clip_id as text again."""
    return spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path).withColumn("clip_id", F.col("clip_id").cast("string"))
