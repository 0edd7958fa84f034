"""Binary change-point segmentation and high-activity regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY


def split_at(x: np.ndarray, min_seg: int) -> tuple[int, float]:
    """The best split of x and its pooled t statistic; (0, -1) if there is none."""
    n = len(x)
    k = np.arange(min_seg, n - min_seg)
    if n < 2 * min_seg or not len(k):
        return 0, -1.0
    s, q = np.cumsum(x), np.cumsum(x * x)
    m1, m2 = s[k - 1] / k, (s[-1] - s[k - 1]) / (n - k)
    v1, v2 = q[k - 1] / k - m1**2, (q[-1] - q[k - 1]) / (n - k) - m2**2
    pooled = (k * v1 + (n - k) * v2) / (n - 2)
    ok = pooled > 1e-12
    if not ok.any():
        return 0, -1.0
    t = np.where(ok, np.abs(m1 - m2) / np.sqrt(np.where(ok, pooled, 1.0) * (1 / k + 1 / (n - k))), -1.0)
    best = int(np.argmax(t))
    return int(k[best]), float(t[best])


def segment(x: np.ndarray, threshold: float = 2.5, min_seg: int = 5) -> list[tuple[int, int]]:
    out, todo = [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        k, t = split_at(x[a:b], min_seg)
        if t > threshold:
            todo += [(a, a + k), (a + k, b)]
        elif b > a:
            out.append((a, b))
    return sorted(out)


def segments(series: DataFrame, *, value: str = "frequency", threshold: float = 2.5, min_seg: int = 5) -> DataFrame:
    """stream_id, seg_start, seg_end (exclusive): positions in the stream's series."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = segment(p.sort_values("bin")["v"].to_numpy(float), threshold, min_seg)
        return pd.DataFrame({KEY: p[KEY].iloc[0], "seg_start": [a for a, _ in found], "seg_end": [b for _, b in found]})

    return series.select(KEY, "bin", F.col(value).alias("v")).groupBy(KEY).applyInPandas(run, "stream_id string, seg_start long, seg_end long")


def best_split(series: DataFrame, *, value: str = "frequency", min_seg: int = 5) -> DataFrame:
    """The first level of segmentation in window functions: stream_id, k, t."""
    up = Window.partitionBy(KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(KEY)
    v = F.col(value)
    d = series.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("bin")).alias("k"), F.count("*").over(all_).alias("n"), F.sum(v).over(up).alias("s"), F.sum(v * v).over(up).alias("q"), F.sum(v).over(all_).alias("s_all"), F.sum(v * v).over(all_).alias("q_all"))
    d = d.where((F.col("k") >= min_seg) & (F.col("k") < F.col("n") - min_seg))
    r = F.col("n") - F.col("k")
    d = d.withColumn("m1", F.col("s") / F.col("k")).withColumn("m2", (F.col("s_all") - F.col("s")) / r)
    d = d.withColumn("p", (F.col("k") * (F.col("q") / F.col("k") - F.col("m1") ** 2) + r * ((F.col("q_all") - F.col("q")) / r - F.col("m2") ** 2)) / (F.col("n") - 2)).where("p > 1e-12")
    d = d.withColumn("t", F.abs(F.col("m1") - F.col("m2")) / F.sqrt(F.col("p") * (1 / F.col("k") + 1 / r)))
    return d.groupBy(KEY).agg(F.max_by("k", F.struct(F.round("t", 9), F.negative("k"))).alias("k"), F.max("t").alias("t"))


def classify(series: DataFrame, segs: DataFrame, *, value: str = "frequency", z: float = 0.0, min_duration: float = 30, max_gap: float = 30, step: float = 10) -> DataFrame:
    """stream_id, region_index, start_seconds, end_seconds: high segments, neighbours and near ones merged, short ones dropped."""
    s = series.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("bin")).alias("i"), "time_seconds", F.col(value).alias("v"))
    stats = s.groupBy(KEY).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).where("sd > 0")
    marks = s.join(segs.select(KEY, (F.col("seg_start") + 1).alias("i"), F.col("seg_start").alias("b")), [KEY, "i"], "left")
    marks = marks.withColumn("b", F.last("b", True).over(Window.partitionBy(KEY).orderBy("i")))
    seg = marks.groupBy(KEY, "b").agg(F.avg("v").alias("m"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("time_seconds").alias("t0"), F.max("time_seconds").alias("t1"))
    high = seg.join(stats, KEY).where(F.col("m") >= F.col("mean") + z * F.col("sd"))
    w = Window.partitionBy(KEY).orderBy("lo")
    high = high.withColumn("g", F.sum(F.when(F.lag("hi").over(w) + 1 == F.col("lo"), 0).otherwise(1)).over(w))
    r = high.groupBy(KEY, "g").agg((F.greatest(F.lit(0.0), F.min("t0") - step / 2)).alias("s"), (F.max("t1") + step / 2).alias("e"))
    w = Window.partitionBy(KEY).orderBy("s")
    r = r.withColumn("g", F.sum(F.when(F.col("s") - F.lag("e").over(w) <= max_gap, 0).otherwise(1)).over(w))
    r = r.groupBy(KEY, "g").agg(F.min("s").alias("start_seconds"), F.max("e").alias("end_seconds")).where(F.col("end_seconds") - F.col("start_seconds") >= min_duration)
    return r.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("start_seconds")).alias("region_index"), "start_seconds", "end_seconds")


def regions(series: DataFrame, *, value: str = "frequency", step: int, threshold: float = 2.5, z: float = 0.0, min_duration: float = 30, max_gap: float = 30) -> DataFrame:
    """High-activity regions of streams with 20 points or more."""
    s = series.withColumn("__n", F.count("*").over(Window.partitionBy(KEY))).where("__n >= 20").drop("__n")
    segs = segments(s, value=value, threshold=threshold, min_seg=max(3, int(min_duration / step / 2)))
    return classify(s, segs, value=value, z=z, min_duration=min_duration, max_gap=max_gap, step=step)
