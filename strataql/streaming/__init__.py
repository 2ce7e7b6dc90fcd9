"""Time windows over event streams; the same code runs on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, time_col: str, late: str | None) -> DataFrame:
    return events.withWatermark(time_col, late) if late and events.isStreaming else events


def windowed(events: DataFrame, time_col: str, width: str, aggregates: list[Column], slide: str | None = None, keys: list[str] = (), late: str | None = "10 minutes") -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``: start, end, keys and aggregates."""
    rows = _marked(events, time_col, late)
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    got = rows.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in got.columns if c != "w"])


def sessions(events: DataFrame, time_col: str, gap: str, aggregates: list[Column], keys: list[str], late: str | None = "10 minutes") -> DataFrame:
    """Sessions of each key that end after a silence of ``gap``."""
    rows = _marked(events, time_col, late)
    got = rows.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(*aggregates)
    return got.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in got.columns if c != "w"])


def deduplicated(events: DataFrame, keys: list[str], time_col: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark on a stream; of all events on a table."""
    if events.isStreaming:
        return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
