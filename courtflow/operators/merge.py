"""Retroactive merges: read numbers and people's resolutions credited to identities after the fact."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_VERDICTS = "clip_id long, window long, identity_id long, number long, source string, ord long, verdict string, n_frames long, n_overlap long, overlap_frames array<long>, existing_number long, existing_source string"
_KEY = ["clip_id", "window", "identity_id"]


def merge_verdicts(events: DataFrame, numbers: DataFrame, triggers: DataFrame) -> DataFrame:
    """What becomes of each trigger, one row each: merged, contradiction, conflict, rejected, repeated or unknown_identity.

    ``events(clip_id, window, frame, identity_id, state)``, ``numbers(clip_id, window, identity_id, number)`` of confirmed identities,
    ``triggers(clip_id, window, identity_id, number, source, ord)``: ``ocr`` ones vouch for candidate frames and go first, ``human``
    ones for candidate and unknown frames; a human one without a number rejects. In order, a trigger whose frames overlap with those
    credited to its number in the window is a contradiction; a human one against another merged number a conflict. Frames that a
    merge has stamped are no candidates any more: a second merge of an identity takes none of them. A trigger of an identity that the
    window lacks has a row of its own, ``unknown_identity``, where a run for one clip would stop.

    Triggers whose number and identity no other trigger of their window has are judged by joins; only the others are folded in order,
    a window at a time, with the frames of their identities and numbers.
    """
    rows = triggers.select(*_KEY, F.col("number").cast("long").alias("number"), "source", F.col("ord").cast("long").alias("ord"))
    by = lambda c: F.count(F.lit(1)).over(Window.partitionBy("clip_id", "window", c))
    rows = rows.withColumn("shared", (by("identity_id") > 1) | (F.col("number").isNotNull() & (by("number") > 1)))
    asked = rows.where("number is not null").select("clip_id", "window", "number").distinct()
    held = events.where("state = 'confirmed'").join(numbers.select(*_KEY, F.col("number").cast("long").alias("number")).hint("merge"), _KEY).join(asked.hint("merge"), ["clip_id", "window", "number"], "left_semi")
    credit = held.groupBy("clip_id", "window", "number").agg(F.collect_set("frame").alias("credit"))
    named = rows.select(*_KEY).distinct()
    of = lambda state: F.collect_set(F.when(F.col("state") == state, F.col("frame")))
    own = events.join(named.hint("merge"), _KEY, "left_semi").groupBy(*_KEY).agg(of("candidate").alias("frames"), of("unknown").alias("more"))
    asks = rows.join(own.hint("merge"), _KEY, "left").join(credit.hint("merge"), ["clip_id", "window", "number"], "left")
    return _apart(asks.where("not shared")).unionByName(_in_order(asks.where("shared")))


def _apart(asks: DataFrame) -> DataFrame:
    """Verdicts of triggers that no other one bears on."""
    frames = F.when(F.col("source") == "ocr", F.col("frames")).otherwise(F.array_union("frames", "more"))
    clash = F.array_sort(F.array_intersect(frames, F.coalesce("credit", F.array().cast("array<long>"))))
    told = asks.withColumn("all", frames).withColumn("clash", clash)
    verdict = F.when(F.col("number").isNull(), "rejected").when(F.col("all").isNull(), "unknown_identity").when(F.size("clash") > 0, "contradiction").otherwise("merged")
    over = F.when(F.col("verdict") == "contradiction", F.col("clash")).otherwise(F.array().cast("array<long>"))
    merged = F.when(F.col("verdict") == "merged", F.size("all")).otherwise(0).cast("long")
    return told.withColumn("verdict", verdict).select(*_KEY, "number", "source", "ord", "verdict", merged.alias("n_frames"), F.size(over).cast("long").alias("n_overlap"), F.slice(over, 1, 10).alias("overlap_frames"),
        F.lit(None).cast("long").alias("existing_number"), F.lit(None).cast("string").alias("existing_source"))


def _in_order(asks: DataFrame) -> DataFrame:
    """Verdicts of triggers that share a number or an identity, in their order."""

    def settle(p: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, set] = {}
        given: dict[int, tuple[int, str]] = {}
        rest: dict[tuple[int, str], set] = {}
        rows = []
        for r in p.assign(_h=p.source != "ocr").sort_values(["_h", "ord", "identity_id", "number"]).itertuples():
            who, number = int(r.identity_id), None if pd.isna(r.number) else int(r.number)
            there = r.frames is not None
            if there:
                rest.setdefault((who, "candidate"), set(r.frames))
                rest.setdefault((who, "unknown"), set(r.more))
            if number is not None:
                taken.setdefault(number, set() if r.credit is None else set(r.credit))
            states = ("candidate",) if r.source == "ocr" else ("candidate", "unknown")
            frames = set().union(*(rest.get((who, s), set()) for s in states))
            clash = sorted(frames & taken.get(number, set()))
            earlier = given.get(who) if r.source != "ocr" else None
            if number is None:
                verdict = "rejected"
            elif earlier:
                verdict = "repeated" if earlier[0] == number else "conflict"
            elif not there:
                verdict = "unknown_identity"
            else:
                verdict = "contradiction" if clash else "merged"
            if verdict == "merged":
                taken[number] |= frames
                given[who] = (number, r.source)
                for s in states:
                    rest[who, s] = set()
            over = clash if verdict == "contradiction" else []
            rows.append((r.clip_id, r.window, who, number, r.source, r.ord, verdict, len(frames) if verdict == "merged" else 0, len(over), over[:10], *(earlier or (None, None))))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _VERDICTS.split(", ")])
        return out.astype({"number": "Int64", "existing_number": "Int64"})

    return asks.groupBy("clip_id", "window").applyInPandas(settle, _VERDICTS)


def merged_events(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The events with the frames of merged triggers stamped ``confirmed_retroactive`` and their number and source; others as they are.

    Each frame has one stamp: an identity's first merge (``ocr`` before ``human``, then ``ord``) takes its candidate frames, a human
    one its unknown frames as well.
    """
    done = verdicts.where("verdict = 'merged'").groupBy(*_KEY).agg(F.min_by(F.struct("number", "source"), F.struct(F.col("source") != "ocr", "ord", "number")).alias("_m"))
    out = events.join(done.hint("merge"), _KEY, "left")
    stamped = F.col("_m").isNotNull() & ((F.col("state") == "candidate") | ((F.col("state") == "unknown") & (F.col("_m.source") == "human")))
    return out.select(*(c for c in events.columns if c != "state"), F.when(stamped, "confirmed_retroactive").otherwise(F.col("state")).alias("state"), F.when(stamped, F.col("_m")).alias("merge"))
