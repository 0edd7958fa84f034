"""Live mode: hopping counts of unbounded message streams under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpulse.operators.series import KEY


def hopping_counts(messages: DataFrame, *, time: str = "ts", window: str = "60 seconds", step: str = "10 seconds", late: str = "1 minute", dedupe: str | None = None) -> DataFrame:
    """stream_id, start, end, frequency of each hopping window; repeats of the dedupe column within the watermark count once."""
    m = messages.withWatermark(time, late)
    if dedupe:
        m = m.dropDuplicatesWithinWatermark([dedupe]) if messages.isStreaming else m.dropDuplicates([dedupe])
    g = m.groupBy(KEY, F.window(time, window, step).alias("w")).agg(F.count("*").alias("frequency"))
    return g.select(KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frequency")


def bursts(messages: DataFrame, *, time: str = "ts", gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions: stream_id, start, end, messages."""
    g = messages.withWatermark(time, late).groupBy(KEY, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("messages"))
    return g.select(KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")
