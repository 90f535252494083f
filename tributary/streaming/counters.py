"""Windowed counters over event streams: activity of users, growth of content and actions of communities as they happen.

Late events count up to the watermark; a closed window is emitted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _windowed(events: DataFrame, keys: list[str], width: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys)


def activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(time, user, value): events of each user by window."""
    return _windowed(events, ["user"], width, late).agg(F.count(F.lit(1)).alias("value")).select(F.col("w.start").alias("time"), "user", "value")


def growth(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(time, root, value): events of each content by window."""
    return _windowed(events, ["root"], width, late).agg(F.count(F.lit(1)).alias("value")).select(F.col("w.start").alias("time"), "root", "value")


def contributors(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(time, root, value): users of each content by window, counted by a sketch of bounded state."""
    return _windowed(events, ["root"], width, late).agg(F.approx_count_distinct("user", 0.01).alias("value")).select(F.col("w.start").alias("time"), "root", "value")
