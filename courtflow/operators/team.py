"""Team layer: occupancy, spacing, side of play, possessions, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.exprs import ZONES, zone_of

def frame_means(positions: DataFrame, where: Column | None = None) -> DataFrame:
    """A1: mean court x of each frame, null where the frame has no counted body."""
    counted = F.col("court_x") if where is None else F.when(where, F.col("court_x"))
    return positions.groupBy("clip_id", "frame").agg(F.avg(counted).alias("mean_x"))


def heatmap(positions: DataFrame, length: float = 84.0, width: float = 50.0, cell: float = 2.0) -> DataFrame:
    """A2: bodies in each cell; bins are half open, the last one closed, outside is dropped."""
    inside = positions.where(F.col("court_x").between(0, length) & F.col("court_y").between(0, width))
    gx = F.least(F.floor(F.col("court_x") / cell), F.lit(int(length / cell) - 1)).alias("gx")
    gy = F.least(F.floor(F.col("court_y") / cell), F.lit(int(width / cell) - 1)).alias("gy")
    return inside.groupBy("clip_id", gx, gy).agg(F.count(F.lit(1)).alias("n"))


def coverage(positions: DataFrame, length: float = 94.0, width: float = 50.0, cell: float = 5.0) -> DataFrame:
    """A3: share of 5-foot cells that a team visits; outside points clamp to edge cells."""
    cols, rows = int(-(-length // cell)), int(-(-width // cell))

    def axis(c: str, n: int) -> Column:
        return F.least(F.greatest((F.col(c) / cell).cast("int"), F.lit(0)), F.lit(n - 1))

    visited = positions.groupBy("clip_id", "team").agg(F.countDistinct(axis("court_x", cols) * rows + axis("court_y", rows)).alias("cells"))
    return visited.withColumn("share", F.col("cells") / (cols * rows))


def spacing(positions: DataFrame) -> DataFrame:
    """A4: mean over frames of the mean distance between a team's bodies; frames with one body don't count.

    Pairs meet within (clip, frame, team), which holds a team's bodies on the floor.
    """
    key = ["clip_id", "frame", "team"]
    a = positions.select(*key, "track_id", F.col("court_x").alias("ax"), F.col("court_y").alias("ay"))
    b = positions.select(*key, F.col("track_id").alias("other"), F.col("court_x").alias("bx"), F.col("court_y").alias("by"))
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    frames = a.join(b, key).where("track_id < other").groupBy(*key).agg(F.avg(d).alias("d"))
    return frames.groupBy("clip_id", "team").agg(F.avg("d").alias("spacing"), F.count(F.lit(1)).alias("frames"))


def zone_occupancy(positions: DataFrame, length: float = 84.0) -> DataFrame:
    """A5: bodies in each of the seven zones, zeros included, and their share."""
    clips = positions.select("clip_id").distinct().select("clip_id", F.explode(F.array(*map(F.lit, ZONES))).alias("zone"))
    counts = positions.groupBy("clip_id", zone_of("court_x", "court_y", length).alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    dense = clips.hint("merge").join(counts, ["clip_id", "zone"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("clip_id"))))


def thirds(positions: DataFrame) -> DataFrame:
    """Bodies of each frame by length-third."""
    x = F.col("court_x")
    return positions.groupBy("clip_id", "frame").agg(
        F.count_if(x < 28).alias("left_n"), F.count_if((x >= 28) & (x < 56)).alias("middle_n"), F.count_if(x >= 56).alias("right_n"), F.count(F.lit(1)).alias("bodies")
    )


def mean_on_court(oncourt: DataFrame) -> DataFrame:
    """Bodies on court for each frame, on average; frames with none count."""
    frames = oncourt.groupBy("clip_id", "frame").agg(F.count_if("is_on").alias("n"))
    return frames.groupBy("clip_id").agg(F.avg("n").alias("mean_on_court"), F.count(F.lit(1)).alias("frames"))


def side_runs(frames: DataFrame, hold: int, half: float = 47.0, dead: float = 0.0) -> DataFrame:
    """Runs of frames on one side that last ``hold`` counted frames; the first run always counts.

    ``frames(clip_id, frame, mean_x)``. Frames without a mean, or within ``dead`` feet of half court, are skipped. A
    swing needs a run of ``hold`` frames (hysteresis as a run-length filter), so it is windows only.
    """
    in_order = Window.partitionBy("clip_id").orderBy("frame")
    side = F.when(F.col("mean_x") < half - dead, "left").when((F.col("mean_x") > half + dead) if dead else (F.col("mean_x") >= half), "right")
    told = frames.withColumn("side", side).where("side is not null")
    told = told.withColumn("k", F.row_number().over(in_order))
    new = F.coalesce((F.lag("side").over(in_order) != F.col("side")).cast("int"), F.lit(0))
    told = told.withColumn("run", F.sum(new).over(in_order))
    inner = Window.partitionBy("clip_id", "run").orderBy("frame")
    told = told.withColumn("place", F.row_number().over(inner))
    runs = told.groupBy("clip_id", "run", "side").agg(F.min("frame").alias("start"), F.max(F.when(F.col("place") == hold, F.col("frame"))).alias("reached"), F.count(F.lit(1)).alias("n"))
    kept = runs.where((F.col("run") == 0) | (F.col("n") >= hold))
    w = Window.partitionBy("clip_id").orderBy("run")
    return kept.withColumn("swing", F.coalesce(F.lag("side").over(w) != F.col("side"), F.lit(True))).where("swing").drop("swing")


def possessions_v1(frames: DataFrame, hold: int = 120) -> DataFrame:
    """(clip_id, side, start, end): a swing stands at the frame that reaches the hold, where the part before it ends; the last ends with the clip."""
    last = frames.groupBy("clip_id").agg(F.max("frame").alias("last"))
    w = Window.partitionBy("clip_id").orderBy("run")
    runs = side_runs(frames, hold).withColumn("at", F.when(F.col("run") == 0, F.col("start")).otherwise(F.col("reached")))
    return runs.join(last, "clip_id").select("clip_id", "side", F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("last")).alias("end"))


def possessions_v2(frames: DataFrame, fps: float = 30.0, half: float = 42.0, dead: float = 6.0, hold_s: float = 1.5, least_s: float = 4.0) -> DataFrame:
    """(clip_id, side, start, end, side_agreement, partial_start, partial_end).

    A swing stands at its run's start; the last segment ends with the last frame on a side. Sides alternate, so an inner segment under
    ``least_s`` that falls to the one before takes the next of that side along: what is left are the first, the last and the long ones,
    and neighbours of one side among them are one possession. A clip without a frame on a side has no row.
    """
    w = Window.partitionBy("clip_id").orderBy("start")
    told = frames.where((F.col("mean_x") < half - dead) | ((F.col("mean_x") > half + dead) if dead else (F.col("mean_x") >= half)))
    last = told.groupBy("clip_id").agg(F.max("frame").alias("last"))
    runs = side_runs(frames, max(1, round(hold_s * fps)), half, dead).join(last, "clip_id")
    parts = runs.select("clip_id", "side", "start", F.coalesce(F.lead("start").over(w) - 1, F.col("last")).alias("end"), "last")
    edge = F.lag("start").over(w).isNull() | F.lead("start").over(w).isNull()
    stays = parts.withColumn("stays", edge | (F.col("end") - F.col("start") + 1 >= round(least_s * fps))).where("stays")
    heads = stays.withColumn("new", F.coalesce(F.lag("side").over(w) != F.col("side"), F.lit(True))).where("new")
    out = heads.select("clip_id", "side", "start", F.coalesce(F.lead("start").over(w) - 1, F.col("last")).alias("end"), F.lag("start").over(w).isNull().alias("partial_start"), F.lead("start").over(w).isNull().alias("partial_end"))
    place = out.withColumn("window", F.row_number().over(w) - 1)
    within = window_of(told.select("clip_id", "frame", F.when(F.col("mean_x") < half, "left").otherwise("right").alias("seen")), out).join(place.select("clip_id", "window", "side"), ["clip_id", "window"])
    share = within.groupBy("clip_id", "window").agg(F.bround(F.avg((F.col("seen") == F.col("side")).cast("double")), 3).alias("side_agreement"))
    return place.join(share, ["clip_id", "window"], "left").select("clip_id", "side", "start", "end", "side_agreement", "partial_start", "partial_end")


def possession_windows(possessions: DataFrame, spans: DataFrame, size: int = 60) -> DataFrame:
    """(clip_id, start, from_possessions): windows that start with possessions, the first at the span's start; clips without
    possessions get windows of ``size`` frames. ``spans(clip_id, span_start, span_end)``, both inclusive."""
    w = Window.partitionBy("clip_id").orderBy("start")
    told = possessions.join(spans, "clip_id").select("clip_id", F.when(F.row_number().over(w) == 1, F.col("span_start")).otherwise(F.col("start")).alias("start"), F.lit(True).alias("from_possessions"))
    bare = spans.join(possessions.select("clip_id").distinct(), "clip_id", "left_anti")
    fixed = bare.select("clip_id", F.explode(F.sequence("span_start", "span_end", F.lit(size).cast("long"))).alias("start"), F.lit(False).alias("from_possessions"))
    return told.unionByName(fixed)


def fixed_window(frame: str = "frame", size: int = 60) -> Column:
    """The window of a frame with windows of fixed length."""
    return F.floor(F.col(frame) / size).alias("window")


def window_of(frames: DataFrame, starts: DataFrame) -> DataFrame:
    """Each frame's window, the last start at or before it (floor 0); ``starts(clip_id, start)``.

    Starts join the frames in one sorted pass per clip, so the as-of join is a shuffle on clip_id, not a nested loop.
    """
    marks = starts.select("clip_id", F.col("start").alias("frame"), F.lit(0).alias("_kind")).distinct()
    both = frames.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("clip_id").orderBy("frame", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("window", F.greatest(F.count_if(F.col("_kind") == 0).over(w) - 1, F.lit(0)))
    return out.where("_kind = 1").drop("_kind")


def state_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of one state over contiguous frames."""
    w = Window.partitionBy(*keys, "state").orderBy("frame")
    marked = rows.withColumn("_i", F.col("frame") - F.row_number().over(w))
    return marked.groupBy(*keys, "state", "_i").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).drop("_i")


def gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The frames between an identity's spans."""
    w = Window.partitionBy(*keys).orderBy("start")
    return spans.withColumn("next", F.lead("start").over(w)).where("next - end > 1").select(*keys, (F.col("end") + 1).alias("start"), (F.col("next") - 1).alias("end"))
