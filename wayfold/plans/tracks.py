"""The base view of tracks over the events table, in two SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The driver's derivation of tracks from events.
BASE = """
SELECT event_id,
  concat('u', cast(user_id as {STR})) AS subject_id,
  concat('d', cast(k % 3 as {STR})) AS device_id,
  unix_s,
  cast(-113 as double) + (user_id % 50) * cast(0.01 as double) + ((event_id * 37) % 1000) / cast(100000 as double) AS lon,
  cast(47 as double) + (user_id % 20) * cast(0.01 as double) + ((event_id * 53) % 1000) / cast(100000 as double) AS lat,
  cast((k * 7) % 125 as double) + cast(0.5 as double) AS accuracy,
  CASE WHEN k % 10 = 0 THEN cast(-1 as double) ELSE value / cast(10 as double) END AS speed,
  CASE WHEN k % 10 = 0 THEN cast(-1 as double) ELSE cast((k * 11) % 360 as double) END AS heading,
  cast((event_id * 13) % 13400 - 400 as double) AS elevation,
  CASE WHEN event_type = 'view' THEN 'Stationary'
       WHEN event_type = 'click' THEN 'Walking'
       WHEN event_type = 'signup' THEN 'Running'
       WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'Bike'
       WHEN event_type = 'purchase' THEN 'Automotive'
       WHEN event_type = 'error' AND k % 4 = 0 THEN 'Fly'
       ELSE '' END AS activity
FROM (SELECT e.*, {K} AS k, {U} AS unix_s FROM {EVENTS} e) t
"""
SPARK_HOLES = {"STR": "string", "K": "cast(get_json_object(props,'$.k') as bigint)", "U": "unix_timestamp(ts)"}
DUCK_HOLES = {"STR": "varchar", "K": "cast(json_extract(props,'$.k') as bigint)", "U": "cast(floor(epoch(ts)) as bigint)", "EVENTS": "events"}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(BASE.format(EVENTS="{events}", **SPARK_HOLES), events=events)


DUCK = BASE.format(**DUCK_HOLES)
