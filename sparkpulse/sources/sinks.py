"""Sinks: chat logs, series, peaks, clips, scripts and metric tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpulse.functions.timefmt import seconds_to_hms


def chat_tsv(df: DataFrame, path: str) -> None:
    df.select("video_time", "author", "message").write.option("sep", "\t").option("header", True).csv(path)


def table_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def sliding_table(series: DataFrame, include_trend: bool = False) -> DataFrame:
    cols = ["stream_id", "time_seconds", seconds_to_hms("time_seconds").alias("time_hms"), "frequency"]
    return series.select(*cols, *(["trend"] if include_trend else []))


def peaks_table(peaks: DataFrame) -> DataFrame:
    """peaks with sample_messages, named as the export has them."""
    return peaks.select("stream_id", F.col("time_seconds").alias("peak_time_seconds"), seconds_to_hms("time_seconds").alias("peak_time_hms"), F.col("value").alias("peak_frequency"), "sample_messages")


def script(df: DataFrame, path: str) -> None:
    df.select("script").write.text(path)
