"""Trajectory tables derived from events: the same text runs in Spark and DuckDB, in exact arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = """
WITH e AS (
  SELECT user_id AS trajectory, event_id, ts, value, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS obs,
         sum((event_id * 7) % 9 - 4) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kx,
         sum((event_id * 13) % 11 - 5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ky
  FROM events),
p AS (
  SELECT trajectory, obs, ts AS time, value, event_type, event_id,
         CAST((trajectory * 92) % 1440 + kx AS BIGINT) AS qx, CAST((trajectory * 28) % 400 - 200 + ky AS BIGINT) AS qy
  FROM e)
SELECT trajectory, CAST(obs AS BIGINT) AS obs, time,
       CAST(((qx % 1440) + 1440) % 1440 - 720 AS DOUBLE) * 0.25 AS lon,
       CAST(least(greatest(qy, -356), 356) AS DOUBLE) * 0.25 AS lat, value * 10 AS z, event_type, event_id
FROM p
"""
REGULAR = f"SELECT trajectory, obs, TIMESTAMP '2024-01-01 00:00:00' + obs * INTERVAL '6' HOUR AS time, lon, lat, z, event_type, event_id FROM ({BASE})"
VARIANTS = {
    "irregular": BASE,
    "regular": REGULAR,
    "grouped": f"SELECT *, CAST(floor(trajectory / 5) AS BIGINT) AS group_id, CAST(trajectory % 5 + 1 AS INT) AS group_member, 5 AS group_size FROM ({REGULAR})",
    "qc": f"SELECT *, CAST(event_id % 4 + 1 AS STRING) AS position_qc, CAST(floor(obs / 3) AS BIGINT) AS cycle_number FROM ({BASE})",
    "invalid": f"SELECT trajectory, obs, time, CASE WHEN event_id % 17 != 0 THEN lon END AS lon, CASE WHEN event_id % 17 != 0 THEN lat END AS lat, z, event_type, event_id FROM ({BASE})",
    "stagnant": f"SELECT t.trajectory, t.obs, t.time, CASE WHEN t.obs > 20 AND t.trajectory % 2 = 0 THEN s.lon ELSE t.lon END AS lon, CASE WHEN t.obs > 20 AND t.trajectory % 2 = 0 THEN s.lat ELSE t.lat END AS lat, t.z, t.event_id FROM ({BASE}) t LEFT JOIN (SELECT trajectory, lon, lat FROM ({BASE}) WHERE obs = 20) s ON t.trajectory = s.trajectory",
}


def tracks(spark: SparkSession, sf_dir: str, variant: str = "irregular") -> DataFrame:
    """A variant over the events of sf_dir; times carry no zone."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("ts", events["ts"].cast("timestamp_ntz"))
    return spark.sql(VARIANTS[variant].replace("FROM events", "FROM {events}"), events=events)
