"""Event-time windows over streams or batches: both take the same DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, size: str, by: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    return _windowed(events, ts, F.window(ts, size), by, aggs, late)


def sliding(events: DataFrame, ts: str, size: str, step: str, by: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    return _windowed(events, ts, F.window(ts, size, step), by, aggs, late)


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    """Runs of events of a key no further apart than the gap."""
    return _windowed(events, ts, F.session_window(ts, gap), by, aggs, late)


def _windowed(events: DataFrame, ts: str, w: Column, by: list[str], aggs: tuple[Column, ...], late: str | None) -> DataFrame:
    if late is not None:
        events = events.withWatermark(ts, late)
    out = events.groupBy(w.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of events of a key where the right one follows within ``seconds``; on streams
    both sides carry watermarks, so state is dropped behind them."""
    if left.isStreaming:
        left, right = left.withWatermark(left_ts, late), right.withWatermark(right_ts, late)
    r = right.withColumnRenamed(key, "_key")
    near = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {seconds} seconds"))
    return left.join(r, (F.col(key) == F.col("_key")) & near).drop("_key")
