"""Popularity counts over an event stream with late data, feeding the same tables as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "user_id", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, key, n) of a stream or a table; rows later than ``late`` behind the newest are left out on streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
