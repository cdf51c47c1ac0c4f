"""Event-time windows and point-in-time joins over ``events``; offered beside the
metadata operators, as batch queries of the same functions streams use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.queries import query, read
from lakelens.streaming import windows

def _n():
    return F.count("*").alias("n")



def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query(
    """SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') + INTERVAL '1 hour' AS window_end,
event_type, count(*) AS n FROM events GROUP BY ALL"""
)
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(windows.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], _n()))


@query(
    """SELECT s AS window_start, s + INTERVAL '2 hours' AS window_end, count(*) AS n FROM (
SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') - to_hours(CAST(i AS INTEGER)) AS s FROM events, range(2) t(i)) GROUP BY s"""
)
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(windows.sliding(read(spark, sf_dir, "events"), "ts", "2 hours", "1 hour", [], _n()))


@query(
    """WITH g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, count(*) AS n FROM g GROUP BY user_id, s"""
)
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(windows.sessions(read(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], _n()))


@query(
    """SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON p.user_id = v.user_id AND v.event_type = 'view' AND p.event_type = 'purchase'
AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL '3600 seconds'"""
)
def join_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("buy_ts"))
    return windows.within(views, buys, "user_id", "view_ts", "buy_ts", 3600).select("view_id", "purchase_id")
