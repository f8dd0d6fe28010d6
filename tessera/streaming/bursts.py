"""Live counts of calls: an addition to the batch rules, whose bursts need a look ahead that a stream hasn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bursts(calls: DataFrame, key: str = "caller", time: str = "ts", window: str = "60 minutes", slide: str = "10 minutes", lateness: str = "30 minutes", least: int = 6) -> DataFrame:
    """Sliding windows in which a caller made ``least`` calls or more; calls later than ``lateness`` are dropped.

    Works on streams and on batches.  State is one counter a caller and open window.
    """
    counted = calls.withWatermark(time, lateness).groupBy(key, F.window(time, window, slide)).agg(F.count("*").alias("calls"))
    return counted.filter(F.col("calls") >= least).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "calls")


def live_sessions(calls: DataFrame, key: str = "caller", time: str = "ts", gap: str = "60 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Stretches of calls without a longer ``gap`` (no test of density, unlike bursts)."""
    grouped = calls.withWatermark(time, lateness).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("calls"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "calls")
