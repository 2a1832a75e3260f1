"""Which team a number that several teams carry belongs to, by jersey colour, and abstention where colours don't tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.operators import colors, identity, quality

#: Crops that are looked at for each identity and number.
SAMPLES = 6
_CLAIM = ["clip_id", "window", "identity_id", "number"]


def claims(events: DataFrame, numbers: DataFrame, rosters: DataFrame) -> DataFrame:
    """Frames that an identity is credited with under a number, with the number's teams: an identity has a group for each of its numbers."""
    teams = rosters.groupBy("clip_id", F.col("number").cast("long").alias("number")).agg(F.array_sort(F.collect_set("team")).alias("teams"))
    credited = identity.named(events.where(F.col("state").isin(*identity.CONFIRMED)), numbers).where("number is not null")
    return credited.select(*_CLAIM, F.struct("frame", "track_id").alias("at")).join(teams.hint("merge"), ["clip_id", "number"])


def dual_teams(events: DataFrame, numbers: DataFrame, rosters: DataFrame, crops: DataFrame, cap: int = SAMPLES, margin: float = 1.4) -> DataFrame:
    """(clip_id, window, identity_id, number, team) of each identity credited with a number of several teams; null: colours abstain.

    ``crops(clip_id, frame, track_id, c0, c1, c2)`` are colour signatures. Up to ``cap`` spread crops of each identity with a number of
    one team make that team's centroid; each crop of the others goes to the nearest centroid if the next is ``margin`` times as far,
    and their majority decides, without one nobody. Clips without such numbers have no rows; a clip with one centroid only abstains.
    """
    told = claims(events, numbers, rosters)
    picks = quality.spread_sample(told.withColumn("several", F.size("teams") > 1).withColumn("team", F.get("teams", F.lit(0))), [*_CLAIM, "several", "team"], "at", cap)
    seen = picks.select(*_CLAIM, "several", "team", F.col("at.frame").alias("frame"), F.col("at.track_id").alias("track_id")).join(crops.select("clip_id", "frame", "track_id", *colors.C).hint("merge"), ["clip_id", "frame", "track_id"], "left")
    reference = colors.centroids(seen.where("not several and c0 is not null"), "team")
    asked = seen.where("several")
    votes = colors.nearest_team(asked.where("c0 is not null"), reference, "team", margin, [*_CLAIM, "frame", "track_id"])
    found = colors.majority(votes, _CLAIM)
    return asked.select(*_CLAIM).distinct().join(found.hint("merge"), _CLAIM, "left")
