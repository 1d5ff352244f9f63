"""An extension: the token ledger as a stream, with windows and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(usage: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Entries and tokens by window and event type of a stream (ts, event_type, tokens); rows later than `late` may be dropped."""
    return usage.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens")).select("window.start", "event_type", "entries", "tokens")
