"""Tracking-shaped tables from the given tables, by SQL that Spark and DuckDB both read.

``SQL[name]`` is a query over events, lineitem or embeddings; ``load`` runs it on the Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtflow.plans.tables import stored

_UNIQUE = """(
  SELECT *, ROW_NUMBER() OVER (PARTITION BY clip_id, frame, track_id ORDER BY event_id) AS rn FROM (
    SELECT event_id, CAST((event_id - event_id %% 2500) / 2500 AS BIGINT) AS clip_id,
      CAST((event_id %% 2500 - event_id %% 10) / 10 AS BIGINT) AS frame, user_id %% 15 AS track_id, event_type,
      CAST(ROUND(value * 100) AS BIGINT) AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
    FROM events) e)"""
_EVENTS = "SELECT %s FROM " + _UNIQUE + " d WHERE rn = 1%s"

SQL = {
    "tracks": _EVENTS % ("clip_id, frame, track_id, event_id AS track_pos, CAST(60+track_id*110+v%120 AS DOUBLE) AS x1, CAST(300+k*2 AS DOUBLE) AS y1, CAST(100+track_id*110+v%120+k%30 AS DOUBLE) AS x2, CAST(370+k*2+v%80 AS DOUBLE) AS y2", ""),
    "oncourt": _EVENTS % ("clip_id, frame, track_id, (470 + CASE WHEN frame%100<50 THEN -180 ELSE 180 END + v%240 - 120)/10.0E0 AS court_x, (k*53%560 - 30)/10.0E0 AS court_y, (k*53%560 - 30) BETWEEN -15 AND 515 AS is_on", ""),
    "reads": _EVENTS % ("clip_id, frame, track_id, (track_id*7 + CASE WHEN v%11=0 THEN 1 ELSE 0 END)%50 AS number, (v%100)/100.0E0 AS conf", " AND event_type IN ('click','view')"),
    "ball": _EVENTS % ("clip_id, frame, event_id AS det_idx, CAST(200+frame*9%1400+v%3 AS DOUBLE) AS cx, CAST(120+(frame%25-12)*(frame%25-12)+k%4 AS DOUBLE) AS cy, (v%100)/100.0E0 AS conf", " AND event_type='purchase'"),
    "shots": _EVENTS % ("clip_id, event_id AS shot_id, frame AS start_frame, frame + 5 + v%12 AS end_frame, CASE WHEN k%2=0 THEN 'far' ELSE 'near' END AS hoop, CASE WHEN v%9<>0 THEN track_id END AS track_id", " AND event_type='signup' AND k%3=0"),
    "scores": _EVENTS % ("clip_id, event_id AS score_id, frame", " AND event_type='error' AND k%7=0"),
    "positions": "SELECT l_suppkey%20 AS clip_id, l_orderkey AS frame, l_linenumber AS track_id, CASE WHEN l_returnflag='A' THEN 'team_a' ELSE 'team_b' END AS team, (l_partkey*37%900 - 30)/10.0E0 AS court_x, (l_suppkey*53+l_linenumber*71)%520/10.0E0 AS court_y FROM lineitem",
}
SQL["crops"] = _EVENTS % ("clip_id, frame, track_id, CAST(40 + 120*(track_id%2) + v%60 AS DOUBLE) AS c0, CAST(50 + k%80 AS DOUBLE) AS c1, CAST(200 - 110*(track_id%2) + (v+k)%70 AS DOUBLE) AS c2", "")
# what a person would type: kinds for three tracks, else the number read most often (the least of those)
SQL["labels_typed"] = f"""SELECT clip_id, track_id, CASE track_id WHEN 3 THEN 'ref' WHEN 5 THEN 'bench' WHEN 8 THEN 'spliced' ELSE CONCAT(number, '') END AS label FROM (
  SELECT clip_id, track_id, number, ROW_NUMBER() OVER (PARTITION BY clip_id, track_id ORDER BY COUNT(*) DESC, number) AS r FROM ({SQL["reads"]}) q GROUP BY clip_id, track_id, number) l WHERE r = 1"""
# teams by parity of the track; track 11's number is on no roster, track 1's on both
SQL["rosters"] = f"""SELECT DISTINCT clip_id, team, number FROM (
  SELECT clip_id, CASE WHEN track_id%2=0 THEN 'team_a' ELSE 'team_b' END AS team, track_id*7%50 AS number FROM ({SQL["reads"]}) q WHERE track_id <> 11
  UNION ALL SELECT clip_id, 'team_a' AS team, track_id*7%50 AS number FROM ({SQL["reads"]}) q WHERE track_id = 1) n"""
_TABLE = {"positions": "lineitem"}


def load(spark: SparkSession, sf_dir: str, name: str, unique: DataFrame | None = None) -> DataFrame:
    """One adapter table, from the ``unique_events`` if they are given. Clips are 2,500 events; see FIXTURES.md."""
    if unique is not None and from_events(name):
        return spark.sql(SQL[name].replace(_UNIQUE % (), "{rows}"), rows=unique)
    table = _TABLE.get(name, "events")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(SQL[name].replace(f"FROM {table}", "FROM {rows}"), rows=rows)


def from_events(name: str) -> bool:
    """Whether an adapter table is a selection of the unique events."""
    return _UNIQUE % () in SQL.get(name, "")


def unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each clip, frame and track, which all tables from events select from: written once where several are read."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return stored(spark.sql(f"SELECT * FROM {_UNIQUE % ()} d WHERE rn = 1".replace("FROM events", "FROM {rows}"), rows=rows))


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour signatures (clip_id, track_id, team_hint, c0, c1, c2)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.selectExpr("vec_id % 8 AS clip_id", "vec_id AS track_id", "label % 2 AS team_hint", *(f"CAST(embedding[{i}] AS DOUBLE) AS c{i}" for i in range(3)))
