"""Event windows as they are used on streams (an extension: the inventory's own operators are all batch).

Every function takes a batch or a streaming DataFrame; streams need the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, keys: list[str], value: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Count and sum of a value per window and key; rows later than ``late`` are dropped on streams only."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows without those that repeat a key inside the watermark (streams) or at all (batch)."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
