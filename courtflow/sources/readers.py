"""Readers and writers of the engine's artifacts: explicit schemas, nested documents to flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS_DOC = "clip string, span_start long, span_len long, fps double, frames array<struct<frame_index: long, tracks: array<struct<track_id: long, bbox: array<double>>>>>"
ONCOURT_DOC = "clip string, frames array<struct<frame_index: long, tracks: map<string, struct<on: boolean, court_feet: array<double>>>>>"
BALL_DOC = "clip string, model string, imgsz long, conf double, frames array<struct<frame_index: long, detections: array<struct<bbox: array<double>, conf: double>>>>"
HOOPS_DOC = "clip string, frames array<struct<frame_index: long, hoop_far_px: array<double>, hoop_near_px: array<double>>>"
DECISIONS_DOC = "clip string, track_labels map<string, string>"


def _frames(spark: SparkSession, path: str, schema: str) -> DataFrame:
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.col("clip").alias("clip_id"), F.explode("frames").alias("f")).select("clip_id", F.col("f.frame_index").alias("frame"), "f.*").drop("frame_index")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frame, track_pos, track_id, x1..y2); a frame without tracks keeps a row of nulls, so the frame spine is whole."""
    rows = _frames(spark, path, TRACKS_DOC).select("clip_id", "frame", F.posexplode_outer("tracks").alias("track_pos", "t"))
    return rows.select("clip_id", "frame", "track_pos", "t.track_id", *(F.get("t.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def read_oncourt(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frame, track_id, is_on, court_x, court_y); a failed anchor is an empty map and gives no rows."""
    rows = _frames(spark, path, ONCOURT_DOC).select("clip_id", "frame", F.explode("tracks").alias("track_id", "t"))
    return rows.select("clip_id", "frame", F.col("track_id").cast("long"), F.col("t.on").alias("is_on"), F.get("t.court_feet", F.lit(0)).alias("court_x"), F.get("t.court_feet", F.lit(1)).alias("court_y"))


def read_ball(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frame, det_idx, cx, cy, conf) in the order of the document."""
    rows = _frames(spark, path, BALL_DOC).select("clip_id", "frame", F.posexplode("detections").alias("det_idx", "d"))
    mid = [(F.get("d.bbox", F.lit(i)) + F.get("d.bbox", F.lit(i + 2))) / 2 for i in (0, 1)]
    return rows.select("clip_id", "frame", "det_idx", mid[0].alias("cx"), mid[1].alias("cy"), "d.conf")


def read_hoops(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frame, hoop, hx, hy); a null hoop has no row."""
    rows = _frames(spark, path, HOOPS_DOC).unpivot(["clip_id", "frame"], ["hoop_far_px", "hoop_near_px"], "hoop", "p").where("p is not null")
    return rows.select("clip_id", "frame", F.regexp_extract("hoop", "hoop_(.*)_px", 1).alias("hoop"), F.get("p", F.lit(0)).alias("hx"), F.get("p", F.lit(1)).alias("hy"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, track_id, label) as text; see ``identity.typed_labels``."""
    docs = spark.read.schema(DECISIONS_DOC).option("multiLine", True).json(path)
    return docs.select(F.col("clip").alias("clip_id"), F.explode("track_labels").alias("track_id", "label")).withColumn("track_id", F.col("track_id").cast("long"))


def write_facts(df: DataFrame, path: str) -> None:
    """A fact table, one folder a clip."""
    df.repartition("clip_id").write.mode("overwrite").partitionBy("clip_id").parquet(path)


def write_box_score(lines: DataFrame, path: str) -> None:
    """JSON with all columns and CSV with two decimals."""
    lines.write.mode("overwrite").json(f"{path}/json")
    flat = [F.format_number(c, 2).alias(c) if t == "double" else F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in lines.dtypes]
    lines.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows: a round trip's check."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
