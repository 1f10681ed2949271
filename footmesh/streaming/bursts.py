"""Streams of requests and attempts: bursts and running metrics, with watermarks for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmesh.operators.folds import debounce


def request_bursts(requests: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of requests by area, on event time; later than the watermark are dropped by the engine."""
    return debounce(requests.withWatermark("requested_at", late), "area_id", "requested_at", gap)


def window_counts(requests: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Requests by area and window of event time."""
    rows = requests.withWatermark("requested_at", late).groupBy(F.window("requested_at", size), "area_id")
    return rows.agg(F.count("*").alias("requests"), F.count_if(F.col("radius_m").isNull()).alias("without_radius")).select(F.col("window.start").alias("start"), "area_id", "requests", "without_radius")
