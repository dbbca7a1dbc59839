"""The windowed operators on streams (an extension: the batch forms are the reference).

Watermarks bound the state; results equal the batch operators' for data that isn't late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rms_envelope(events: DataFrame, at: str, value: str, keys: list[str], window: str = "3 hours", hop: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sliding root mean square with event-time watermark."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, window, hop), *keys)
    return rows.agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rms", "n")


def session_regions(events: DataFrame, at: str, keys: list[str], gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions closed by a gap."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys)
    return rows.agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).select(*keys, F.col("first").alias("start"), F.col("last").alias("end"), "n")
