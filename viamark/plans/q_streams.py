"""Queries: live forms of trace operators. The events that are there arrive as a stream, which is stopped half-way and started again."""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.plans.catalog import query
from viamark.streaming import live

_WINDOWS = """
SELECT user_id AS drive, time_bucket(INTERVAL 1 DAY, ts) AS minute, count(*) AS fixes, sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS off_route FROM events GROUP BY 1, 2"""
_SESSIONS = """
WITH s AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE value < 30 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id AS drive, min(ts) AS begin, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds, count(*) AS fixes, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 86400 AS parked FROM i GROUP BY user_id, island HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 3600"""


def _fixes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("drive"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("speed"), F.col("value").alias("off"), F.col("event_id").alias("x"))


@query(_SESSIONS)
def x1_live_stops(spark, sf_dir):
    """Sessions of slow fixes a day apart at most, from a stream that goes on from its checkpoint."""
    out, _ = live.replayed(_fixes(spark, sf_dir), lambda s: live.live_stops(s, "24 hours", "48 hours", 30.0, 3600.0, 86400.0))
    return out.select("drive", F.col("begin").cast("timestamp_ntz").alias("begin"), F.round("seconds", 3).alias("seconds"), "fixes", "parked")


@query(_WINDOWS)
def x2_live_counters(spark, sf_dir):
    """Fixes and fixes off the line by drive and day, from a stream that goes on from its checkpoint."""
    out, _ = live.replayed(_fixes(spark, sf_dir), lambda s: live.live_counters(s, "1 day", "2 days"))
    return out.select("drive", F.col("minute").cast("timestamp_ntz").alias("minute"), "fixes", "off_route")
