"""Event-time windows; the same plan over a batch or a stream.

On a stream, give ``late``: rows later than that behind the newest seen are
dropped and windows come out when they can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming and late else df


def tumbling(df: DataFrame, ts: str, length: str, key: str, value: str, slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """``window_start, key, events, total`` of tumbling (or, with ``slide``, sliding) windows; null times are left out."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = _marked(df, ts, late).filter(F.col(ts).isNotNull()).groupBy(w.alias("w"), key).agg(F.count("*").alias("events"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "events", "total")


def sessions(df: DataFrame, ts: str, gap: str, key: str, value: str, late: str | None = "10 minutes") -> DataFrame:
    """``key, session_start, events, total``: events less than ``gap`` apart belong together."""
    out = _marked(df, ts, late).filter(F.col(ts).isNotNull()).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"), F.round(F.sum(value), 4).alias("total"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "events", "total")
