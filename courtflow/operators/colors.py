"""Colour signatures: centroids, nearest team with a margin, two-cluster split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.plans.tables import stored

C = ["c0", "c1", "c2"]


def centroids(colors: DataFrame, group: str = "team_hint") -> DataFrame:
    """Mean signature of each team; teams without samples have no row."""
    return colors.groupBy("clip_id", group).agg(*(F.avg(c).alias(c) for c in C), F.count(F.lit(1)).alias("n"))


def nearest_team(colors: DataFrame, teams: DataFrame, group: str = "team_hint", margin: float = 1.4, keys: Sequence[str] = ("clip_id", "track_id")) -> DataFrame:
    """The nearest centroid if the second is ``margin`` times as far, else null; needs two centroids.

    Teams of a clip are a handful, so each signature meets only its clip's centroids.
    """
    t = teams.select("clip_id", F.col(group).alias("team"), *(F.col(c).alias(f"t_{c}") for c in C))
    d = F.sqrt(sum(((F.col(c) - F.col(f"t_{c}")) * (F.col(c) - F.col(f"t_{c}")) for c in C[1:]), (F.col("c0") - F.col("t_c0")) * (F.col("c0") - F.col("t_c0"))))
    met = colors.select(*keys, *C).join(t.hint("merge"), "clip_id").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(d.alias("d"), "team"))).alias("a"))
    best, second = F.get("a", F.lit(0)), F.get("a", F.lit(1))
    clear = second["d"] >= margin * F.greatest(best["d"], F.lit(1e-6))
    return met.select(*keys, F.when(clear, best["team"]).alias("team"), best["d"].alias("dist"))


def majority(votes: DataFrame, keys: list[str], value: str = "team") -> DataFrame:
    """The most frequent value of each key, null on a tie or without votes."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    top = counts.withColumn("top", F.max("n").over(w)).where("n = top").groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min(value).alias("v"))
    return votes.select(*keys).distinct().join(top, keys, "left").select(*keys, F.when(F.col("k") == 1, F.col("v")).alias(value))


def two_clusters(colors: DataFrame, rounds: int = 20) -> DataFrame:
    """K-means with two clusters for all clips at once; one aggregation a round.

    Starts from each clip's signatures of least and largest sum; clips with one track are all team 0.
    """
    total = F.col("c0") + F.col("c1") + F.col("c2")
    ends = colors.groupBy("clip_id").agg(*(F.min_by(c, F.struct(total, "track_id")).alias(f"a_{c}") for c in C), *(F.max_by(c, F.struct(total, "track_id")).alias(f"b_{c}") for c in C))

    def dist(p: str):
        return sum(((F.col(c) - F.col(f"{p}_{c}")) * (F.col(c) - F.col(f"{p}_{c}")) for c in C[1:]), (F.col("c0") - F.col(f"{p}_c0")) * (F.col("c0") - F.col(f"{p}_c0")))

    for i in range(rounds):
        side = colors.join(ends.hint("merge"), "clip_id").withColumn("k", (dist("b") < dist("a")).cast("int"))
        mean = [F.coalesce(F.avg(F.when(F.col("k") == k, F.col(c))), F.first(f"{p}_{c}")).alias(f"{p}_{c}") for k, p in ((0, "a"), (1, "b")) for c in C]
        ends = side.groupBy("clip_id").agg(*mean)
        if i % 5 == 4:
            ends = stored(ends)  # a row a clip; cuts the lineage of the rounds before
    return colors.join(ends.hint("merge"), "clip_id").select("clip_id", "track_id", (dist("b") < dist("a")).cast("int").alias("team"))
