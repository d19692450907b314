"""Streaming bars (an addition of this engine): ticks with a watermark to bars of a fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``ticks`` has ``symbol, ts, price, seq``. A bar is emitted once the watermark has passed its end, which
    is the streaming form of the completed-candle rule; works on batch frames too."""
    order = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
