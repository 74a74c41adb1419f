"""Running weighted marginals over a stream: watermarked windows of partial sums (an addition of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_marginals(events: DataFrame, time: str, dim: str, weight: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, level, weight, records; works on streams and tables alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    sums = rows.where(F.col(dim).isNotNull()).groupBy(F.window(time, window).alias("w"), F.col(dim).alias("level")).agg(F.sum(weight).alias("weight"), F.count("*").alias("records"))
    return sums.select(F.col("w.start").alias("start"), "level", "weight", "records")
