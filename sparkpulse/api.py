"""The engine behind one object: a set of chat streams with their series, peaks, regions and clips, each worked out on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpulse.operators import intervals as I
from sparkpulse.operators import peaks as P
from sparkpulse.operators import segments as G
from sparkpulse.operators import series as S
from sparkpulse.sources import readers, sinks


class Analyzer:
    """messages has stream_id, row_id, message and seconds."""

    def __init__(self, messages: DataFrame, *, step: int = 10, window: int = 60, degree: int = 3):
        self.messages, self.step, self.window, self.degree = messages, step, window, degree

    @classmethod
    def from_tsv(cls, spark: SparkSession, path: str, **parameters) -> Analyzer:
        return cls(readers.chat_tsv(spark, path), **parameters)

    @cached_property
    def histogram(self) -> DataFrame:
        return S.histogram(self.messages, self.step)

    @cached_property
    def series(self) -> DataFrame:
        return S.sliding(self.histogram, self.step, self.window)

    @cached_property
    def normalized(self) -> DataFrame:
        return S.normalized(self.series, self.degree)

    def peaks(self, prominence: float, start: float | None = None, end: float | None = None) -> DataFrame:
        return S.between(P.peaks(self.series, step=self.step, window=self.window, prominence=prominence), start, end)

    def regions(self, z: float = 0.0, min_duration: float = 30.0, max_gap: float = 30.0) -> DataFrame:
        return G.regions(self.normalized, value="normalized", step=self.step, min_duration=min_duration, max_gap=max_gap, z=z)

    def clips(self, prominence: float, before: float, after: float) -> DataFrame:
        return I.clips(self.peaks(prominence), before, after)

    def histogram_table(self) -> DataFrame:
        return self.histogram.select("stream_id", (F.col("bin") * self.step).alias("bin_start"), ((F.col("bin") + 1) * self.step).alias("bin_end"), F.col("cnt").alias("raw_count"))

    def sliding_table(self, start: float | None = None, end: float | None = None) -> DataFrame:
        return sinks.sliding_table(S.between(S.trend(self.series, self.degree), start, end), include_trend=self.degree > 0)

    def peaks_table(self, prominence: float, start: float | None = None, end: float | None = None, margin: float = 10.0) -> DataFrame:
        p = self.peaks(prominence, start, end).withColumn("id", F.col("bin"))
        return sinks.peaks_table(I.sample_messages(p, self.messages, margin=margin))

    def regions_table(self, z: float = 0.0, start: float | None = None, end: float | None = None) -> DataFrame:
        r = I.within(self.regions(z), start, end, "start_seconds", "end_seconds")
        return S.with_hms(r, "start_seconds", "end_seconds").withColumn("duration_seconds", F.col("end_seconds") - F.col("start_seconds"))

    def clips_table(self, prominence: float, before: float, after: float) -> DataFrame:
        c = self.clips(prominence, before, after)
        index = F.row_number().over(Window.partitionBy("stream_id").orderBy("start")).alias("clip_index")
        t = c.select("stream_id", index, F.col("start").alias("start_seconds"), F.col("time_seconds").alias("peak_seconds"), F.col("end").alias("end_seconds"), F.col("value").alias("peak_frequency"))
        return S.with_hms(t, "start_seconds", "peak_seconds", "end_seconds")

    def script(self, prominence: float, before: float, after: float, video: str) -> DataFrame:
        return I.reel_script(I.union(self.clips(prominence, before, after)), video)
