"""Camera motion: cumulative frame transforms, keyframe chains, and hoops carried from their anchors to all frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions import exprs as X
from courtflow.operators.reports import plausible

#: Scale change that a step between frames may have.
LEAST_SCALE, MOST_SCALE = 0.7, 1.4
#: Frames that one group multiplies; what a clip's blocks amount to is multiplied in a second, much smaller pass.
BLOCK = 1000


def sane(g: Column) -> Column:
    """Whether a step (nine numbers, row by row) is a usable camera motion: finite, and of a scale near 1; false for null."""
    whole = F.forall(g, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    at = lambda i: F.get(g, F.lit(i))
    scale = F.sqrt(F.abs(at(0) * at(4) - at(1) * at(3)))
    return F.coalesce((F.size(g) == 9) & whole & (scale > LEAST_SCALE) & (scale < MOST_SCALE), F.lit(False))


def times(a: Column, b: Column) -> Column:
    """The product of two transforms as arrays of nine, not normalised."""
    return F.array(*(sum((F.get(a, F.lit(3 * i + k)) * F.get(b, F.lit(3 * k + j)) for k in (1, 2)), F.get(a, F.lit(3 * i)) * F.get(b, F.lit(j))) for i in range(3) for j in range(3)))


def normalised(m: Column) -> Column:
    """Divided by the last element, unless that is 0."""
    last = F.get(m, F.lit(8))
    return F.when(last != 0, F.transform(m, lambda x: x / last)).otherwise(m)


def _prefixes(name: str, exclusive: bool):
    """A pandas function that replaces the column ``name`` of rows in order by the products up to each row, or before it."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("at")
        now, out = np.eye(3), []
        for g in p[name]:
            if exclusive:
                out.append(now.ravel())
            now = now if g is None else now @ np.asarray(g, float).reshape(3, 3)
            if not exclusive:
                out.append(now.ravel())
        return p.assign(**{name: out})

    return run


def cumulative_transforms(steps: DataFrame, anchors: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """ST12: A_t = A_(t-1) g_t for each frame: (clip_id, frame, a, held, lost, h).

    ``steps(clip_id, frame, g array<double>)`` map a frame's pixels to those of the frame before. The first frame of a clip has the
    identity, whatever its step says. A step that is missing or not ``sane`` is ``held``: A stays as it is, and ``lost`` counts such
    frames so far. ``h`` is the anchor's transform times A, normalised, where ``anchors(clip_id, h0)`` has the clip; else null.
    Products of matrices can be taken in parts, so blocks of frames are multiplied apart, then the blocks of a clip in order; no task
    holds a clip.
    """
    order = Window.partitionBy("clip_id").orderBy("frame")
    rows = steps.select("clip_id", "frame", F.when(sane(F.col("g")), F.col("g")).alias("g"), F.floor(F.col("frame") / block).alias("block"), F.row_number().over(order).alias("_i"))
    rows = rows.withColumn("held", (F.col("_i") > 1) & F.col("g").isNull()).withColumn("lost", F.count_if("held").over(order)).withColumn("g", F.when(F.col("_i") > 1, F.col("g")))
    kind = "clip_id {clip}, block long, at long, a array<double>, held boolean, lost long".format(clip=steps.schema["clip_id"].dataType.simpleString())
    inner = rows.select("clip_id", "block", F.col("frame").cast("long").alias("at"), F.col("g").alias("a"), "held", "lost").groupBy("clip_id", "block").applyInPandas(_prefixes("a", False), kind)
    return _joined(inner, anchors)


def _joined(inner: DataFrame, anchors: DataFrame | None) -> DataFrame:
    from courtflow.plans.tables import stored

    inner = stored(inner)  # read twice: for what blocks amount to, and for the frames
    clip = inner.schema["clip_id"].dataType.simpleString()
    whole = inner.groupBy("clip_id", F.col("block").alias("at")).agg(F.max_by("a", "at").alias("before"))
    before = whole.groupBy("clip_id").applyInPandas(_prefixes("before", True), f"clip_id {clip}, at long, before array<double>")
    out = inner.withColumnRenamed("at", "frame").join(before.withColumnRenamed("at", "block").hint("merge"), ["clip_id", "block"])
    out = out.withColumn("a", times(F.col("before"), F.col("a"))).drop("before", "block")
    if anchors is None:
        return out.withColumn("h", F.lit(None).cast("array<double>"))
    met = out.join(anchors.select("clip_id", "h0").hint("merge"), "clip_id", "left")
    return met.withColumn("h", F.when(F.col("h0").isNotNull(), normalised(times(F.col("h0"), F.col("a"))))).drop("h0")


def keyframe_chain(hops: DataFrame, reference: DataFrame) -> DataFrame:
    """ST12 for keyframes: (clip_id, pos, h), the transform of each keyframe's pixels to the reference keyframe's, null beyond a failed hop.

    ``hops(clip_id, pos, fwd array<double>)``: from keyframe ``pos`` to the next one, null where it failed (the last keyframe has none);
    ``reference(clip_id, ref_pos)``. Before the reference hops are taken as they are, after it inverted. A clip has a handful of keyframes.
    """
    clip = hops.schema["clip_id"].dataType.simpleString()

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos").reset_index(drop=True)
        n, ref = len(p), int(np.flatnonzero(p.pos == p.ref_pos)[0]) if (p.pos == p.ref_pos).any() else None
        out: list = [None] * n
        norm = lambda m: m / m[2, 2] if m[2, 2] != 0 else m
        hop = [None if f is None else np.asarray(f, float).reshape(3, 3) for f in p.fwd]
        if ref is not None:
            out[ref] = np.eye(3)
            for i in range(ref - 1, -1, -1):
                out[i] = None if hop[i] is None or out[i + 1] is None else norm(out[i + 1] @ hop[i])
            for i in range(ref + 1, n):
                singular = hop[i - 1] is None or np.linalg.det(hop[i - 1]) == 0
                out[i] = None if singular or out[i - 1] is None else norm(out[i - 1] @ np.linalg.inv(hop[i - 1]))
        return pd.DataFrame({"clip_id": p.clip_id, "pos": p.pos, "h": [None if m is None else m.ravel() for m in out]})

    return hops.join(reference.hint("merge"), "clip_id").groupBy("clip_id").applyInPandas(chain, f"clip_id {clip}, pos long, h array<double>")


def carried_hoops(frames: DataFrame, matches: DataFrame, keyframes: DataFrame, anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """H7: where each hoop is in each frame: (clip_id, frame, hoop, hx, hy, keyframe, status).

    ``frames(clip_id, frame)``; ``matches(clip_id, frame, keyframe, m)``: a frame's pixels to its keyframe's; ``keyframes(clip_id, keyframe,
    k)``: to the reference's; ``anchors(clip_id, hoop, keyframe, px, py)``: the hoop as clicked in one keyframe; ``sizes(clip_id, width,
    height)`` of the picture. The anchor goes to the reference once, and back through k m for each frame. status is "carried", or with a
    null place "no match", "degenerate" (no inverse or no depth) or "implausible" (P10).
    """
    nine = lambda c, x: [F.get(c, F.lit(i)).alias(f"{x}{i}") for i in range(9)]
    rx, ry, _ = X.project([F.get("k", F.lit(i)) for i in range(9)], "px", "py")
    rims = anchors.join(keyframes.hint("merge"), ["clip_id", "keyframe"]).select("clip_id", "hoop", rx.alias("rx"), ry.alias("ry"))
    whole = matches.join(keyframes.hint("merge"), ["clip_id", "keyframe"]).select("clip_id", "frame", "keyframe", *nine("k", "k"), *nine("m", "m"))
    back = X.inverse(X.compose([f"k{i}" for i in range(9)], [f"m{i}" for i in range(9)]))
    back = whole.select("clip_id", "frame", "keyframe", F.lit(True).alias("_matched"), *(c.alias(f"t{i}") for i, c in enumerate(back)))
    wide = frames.select("clip_id", "frame").distinct().join(back.hint("merge"), ["clip_id", "frame"], "left").join(rims.hint("merge"), "clip_id").join(sizes.hint("merge"), "clip_id")
    x, y, _ = X.project([f"t{i}" for i in range(9)], "rx", "ry")
    placed = wide.withColumn("x", x).withColumn("y", y)
    fits = plausible(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    status = F.when(F.col("_matched").isNull(), "no match").when(F.col("x").isNull() | F.col("y").isNull(), "degenerate").when(~fits, "implausible").otherwise("carried")
    told = placed.withColumn("status", status)
    good = F.col("status") == "carried"
    return told.select("clip_id", "frame", "hoop", F.when(good, F.col("x")).alias("hx"), F.when(good, F.col("y")).alias("hy"), "keyframe", "status")


def stabilised(dets: DataFrame, transforms: DataFrame) -> DataFrame:
    """ST13: detections with their centres in the pixels of the clip's first frame, for chaining while the camera pans.

    ``dets(clip_id, frame, det_idx, cx, cy, conf)``, ``transforms(clip_id, frame, a)`` (ST12). Without a transform, or where the point has no
    depth, a detection stays where it was seen.
    """
    met = dets.join(transforms.select("clip_id", "frame", "a").hint("merge"), ["clip_id", "frame"], "left")
    x, y, _ = X.project([F.get("a", F.lit(i)) for i in range(9)], "cx", "cy")
    seen = [c for c in dets.columns if c not in ("cx", "cy")]
    return met.select(*seen, F.coalesce(x, F.col("cx")).alias("cx"), F.coalesce(y, F.col("cy")).alias("cy"))
