"""Which frames of a body are worth looking at: W11 to W13 and the work list I10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least box heights, spacings in frames and most picks of each rule.
PURITY = {"height": 90.0, "slices": 6, "spacing": 3, "cap": 12}
REVIEW = {"height": 60.0, "slices": 6, "spacing": 5}
READS = {"height": 90.0, "spacing": 2, "cap": 10}


def _spaced(picks: Column, spacing: int, cap: int | None) -> Column:
    """The picks (structs with ``frame``), in order, that are ``spacing`` frames or more from all taken before them, ``cap`` at most."""

    def take(taken: Column, p: Column) -> Column:
        far = F.forall(taken, lambda t: F.abs(t["frame"] - p["frame"]) >= spacing)
        room = F.lit(True) if cap is None else F.size(taken) < cap
        return F.when(far & room, F.concat(taken, F.array(p))).otherwise(taken)

    return F.aggregate(picks, F.array().cast("array<struct<frame:bigint,h:double>>"), take)


def _tall(rows: DataFrame, keys: list[str], height: float) -> DataFrame:
    good = rows.withColumn("h", (F.col("y2") - F.col("y1")).cast("double")).where(F.col("h") >= height)
    w = Window.partitionBy(*keys)
    return good.select(*keys, F.col("frame").cast("long").alias("frame"), "h", (F.row_number().over(w.orderBy("frame")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))


def _by_slice(tall: DataFrame, keys: list[str], part: Column, spacing: int, cap: int | None) -> DataFrame:
    """The tallest of each slice (the first on a tie), then those that keep apart, in the order of slices."""
    best = tall.groupBy(*keys, part.alias("_p")).agg(F.max_by(F.struct("frame", "h"), F.struct("h", -F.col("frame"))).alias("b"))
    taken = _spaced(F.transform(F.array_sort(F.collect_list(F.struct("_p", "b"))), lambda x: x["b"]), spacing, cap)
    return best.groupBy(*keys).agg(taken.alias("_t")).select(*keys, F.posexplode("_t").alias("pick", "_b")).select(*keys, "pick", F.col("_b.frame").alias("frame"), F.col("_b.h").alias("h"))


def purity_crops(tracks: DataFrame, height: float = 90.0, slices: int = 6, spacing: int = 3, cap: int = 12) -> DataFrame:
    """(clip_id, track_id, pick, frame, h): the tallest box of each of a track's slices, with spacing and a cap.

    Boxes of ``height`` px or more are cut, in order, into slices of n // ``slices`` boxes (one at least; the last may be shorter). A
    pick that lies within ``spacing`` frames of an earlier one is left out.
    """
    keys = ["clip_id", "track_id"]
    part = F.floor(F.col("i") / F.greatest(F.floor(F.col("n") / slices), F.lit(1)))
    return _by_slice(_tall(tracks, keys, height), keys, part, spacing, cap)


def review_crops(rows: DataFrame, keys: list[str], height: float = 60.0, slices: int = 6, spacing: int = 5) -> DataFrame:
    """As W11 for each of ``keys``, but with ``slices`` slices at most: the last takes what is left over."""
    part = F.least(F.floor(F.col("i") / F.greatest(F.floor(F.col("n") / slices), F.lit(1))), F.lit(slices - 1))
    return _by_slice(_tall(rows, keys, height), keys, part, spacing, None)


def largest_spaced(rows: DataFrame, keys: list[str], height: float = 90.0, spacing: int = 2, cap: int = 10) -> DataFrame:
    """(keys.., pick, frame, h): boxes by falling height (the earlier on a tie), each ``spacing`` frames or more from all before it.

    A pick bars no more than 2 * spacing - 2 others, so the first cap * (2 * spacing - 1) boxes of a key hold all its picks; nothing
    else is gathered. Rows of one key have frames of their own.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("h"), "frame")
    first = _tall(rows, keys, height).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap * (2 * spacing - 1))
    order = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.struct("frame", "h").alias("b")))), lambda x: x["b"])
    taken = first.groupBy(*keys).agg(_spaced(order, spacing, cap).alias("_t"))
    return taken.select(*keys, F.posexplode("_t").alias("pick", "_b")).select(*keys, "pick", F.col("_b.frame").alias("frame"), F.col("_b.h").alias("h"))


def work_list(tracks: DataFrame, oncourt: DataFrame, seeds: DataFrame, spliced: DataFrame, fps: float = 30.0) -> DataFrame:
    """(clip_id, rank, track_id, floor_seconds, windows, frames, quarantined): the tracks that a person should name, most floor time first.

    ``seeds(clip_id, window, track_id)`` tell which tracks are asked for and where; ``frames`` are the crops to show (W12); a track in
    ``spliced(clip_id, track_id)`` is quarantined: it can't have a number.
    """
    key = ["clip_id", "track_id"]
    asked = seeds.groupBy(*key).agg(F.array_sort(F.collect_set("window")).alias("windows"))
    floor = oncourt.where("is_on").groupBy(*key).agg(F.count(F.lit(1)).alias("_f"))
    shown = review_crops(tracks.join(asked.select(*key).hint("merge"), key, "left_semi"), key).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "frame"))), lambda x: x["frame"]).alias("frames"))
    bad = spliced.select(*key, F.lit(True).alias("_bad")).distinct()
    out = asked
    for more in (floor, shown, bad):
        out = out.join(more.hint("merge"), key, "left")
    seconds = F.bround(F.coalesce("_f", F.lit(0)) / fps, 1)
    told = out.select(*key, seconds.alias("floor_seconds"), "windows", F.coalesce("frames", F.array().cast("array<bigint>")).alias("frames"), F.coalesce("_bad", F.lit(False)).alias("quarantined"))
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("floor_seconds"), "track_id")))
