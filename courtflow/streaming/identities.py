"""ST8: identity events from a stream of tracks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from courtflow.operators.identity import MAX_GAP, TrackFold

EVENTS = "clip_id long, window long, frame long, track_id long, track_pos long, run int, state string, reason string, gap_frames long, distance_px double"
#: The provider that state with timers needs, as (setting, value).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_KEY = ["clip_id", "window", "track_id"]
_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


class IdentityProcessor(StatefulProcessor):
    """Folds the rows of one track in one window as ``TrackFold`` does for batches.

    State: the last frame and its place among the clip's frames, and the fold. A row at or before the last frame is refused: an event
    with state "refused" that changes nothing. A timer, a gap's length of event time after a track's last row, forgets identities that
    no return can reach; the count of identities stays, so that their numbers are not given out twice.
    """

    def __init__(self, fps: float):
        self.fps = fps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "body string")

    def _load(self) -> tuple[int | None, int | None, TrackFold]:
        if not self.state.exists():
            return None, None, TrackFold()
        frame, order, now, lost, n = json.loads(self.state.get()[0])
        return frame, order, TrackFold(now, lost, n)

    def _save(self, frame: int, order: int, fold: TrackFold) -> None:
        self.state.update((json.dumps([frame, order, fold.now, fold.lost, fold.n]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, order, fold = self._load()
        before, last = frame, 0
        out = []
        clip, window, track = (int(k) for k in key)
        for r in pd.concat(list(rows)).sort_values(["frame", "track_pos"]).itertuples():
            if frame is not None and r.frame <= frame:
                out.append((clip, window, r.frame, track, r.track_pos, None, "refused", "out of order", None, None))
                continue
            x, y = (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2
            reason, gap, dist = "continuing", None, None
            if order is None or r.ord - order > 1:
                fold.leave()
            if fold.now is None:
                reason, gap, dist = fold.arrive(int(r.frame), float(x), float(y), r.seed if isinstance(r.seed, str) else None)
            fold.stay([(int(r.frame), float(x), float(y))])
            frame, order, last = int(r.frame), int(r.ord), int(r.millis)
            out.append((clip, window, frame, track, r.track_pos, fold.now[0], fold.now[1], reason, gap, dist))
        if frame != before:
            fold.forget(frame)
            self._save(frame, order, fold)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            # once the watermark is there, rows that still come in are further from this track's last one than any gap
            self.handle.registerTimer(last + int(1000 * (MAX_GAP + 1) / self.fps) + 1)
        table = pd.DataFrame(out, columns=_COLUMNS)
        yield table.astype({"run": "Int32", "gap_frames": "Int64", "distance_px": "Float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame, order, fold = self._load()
        if frame is not None:
            fold.leave()
            fold.forget(frame + MAX_GAP)
            self._save(frame, order, fold)
        return iter([])

    def close(self) -> None:
        pass


def identity_stream(tracks: DataFrame, seeds: DataFrame | None = None, fps: float = 30.0, late: str = "5 seconds") -> DataFrame:
    """ST8: the events of ST1 (and "refused" ones) from a streaming table, in append mode.

    ``tracks(clip_id, window, frame, ord, ts, track_id, track_pos, x1..y2)``: ``ord`` numbers the frames of a clip in which anything was
    looked for, ``ts`` is event time. ``seeds(clip_id, window, track_id)`` with or without ``reason`` is a table at rest. The session
    needs the state store of ``STATE_STORE``.
    """
    if seeds is None:
        rows = tracks.withColumn("seed", F.lit(None).cast("string"))
    else:
        reason = F.min("reason") if "reason" in seeds.columns else F.lit("seed")
        rows = tracks.join(seeds.groupBy(*_KEY).agg(reason.alias("seed")), _KEY, "left")
    rows = rows.where("track_id is not null").withWatermark("ts", late)
    need = rows.select(*_KEY, "frame", "ord", "ts", F.unix_millis("ts").alias("millis"), "track_pos", "x1", "y1", "x2", "y2", "seed")
    return need.groupBy(*_KEY).transformWithStateInPandas(IdentityProcessor(fps), EVENTS, "Append", "EventTime")
