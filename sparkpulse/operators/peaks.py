"""Peak detection: plateau-aware local maxima, spacing, prominence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY


def local_maxima(series: DataFrame, value: str = "frequency") -> DataFrame:
    """Runs of equal values higher than both neighbours, at their middle (rounded down); runs at an edge don't count."""
    w = Window.partitionBy(KEY).orderBy("bin")
    d = series.select(KEY, "bin", F.col(value).alias("v"))
    d = d.withColumn("run", F.sum(F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1)).over(w))
    r = d.groupBy(KEY, "run").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.first("v").alias("v"))
    w = Window.partitionBy(KEY).orderBy("run")
    r = r.withColumn("before", F.lag("v").over(w)).withColumn("after", F.lead("v").over(w))
    return r.where("v > before and v > after").select(KEY, F.floor((F.col("lo") + F.col("hi")) / 2).alias("bin"), F.col("v").alias("value"))


def candidates(x: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.concatenate([starts[1:], [len(x)]]) - 1
    v = x[starts]
    inner = np.zeros(len(v), bool)
    inner[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return (starts[inner] + ends[inner]) // 2


def spaced(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Highest first (of equals the later), each removes those nearer than distance."""
    keep = np.ones(len(at), bool)
    for i in np.lexsort((at, height))[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    return at[keep]


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points on the way to a higher sample or the edge."""
    out = np.zeros(len(at))
    for k, i in enumerate(at):
        left = np.flatnonzero(x[:i] > x[i])
        right = np.flatnonzero(x[i + 1 :] > x[i])
        lo = left[-1] + 1 if len(left) else 0
        hi = i + 1 + right[0] if len(right) else len(x)
        out[k] = x[i] - max(x[lo : i + 1].min(), x[i:hi].min())
    return out


def peaks(series: DataFrame, *, value: str = "frequency", step: int, window: int, prominence: float = 5.0, min_distance_ratio: float = 0.5) -> DataFrame:
    """stream_id, bin, time_seconds, value, prominence of each peak: spacing first, then prominence; under three points none.

    A stream's series has duration / step points and is handled in one Arrow group."""
    distance = max(1, int(window * min_distance_ratio / step))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("bin")
        x = p["v"].to_numpy(float)
        at = spaced(c, x[c], distance) if len(x) >= 3 and len(c := candidates(x)) else np.zeros(0, int)
        prom = prominences(x, at)
        at, prom = at[prom >= prominence], prom[prom >= prominence]
        return pd.DataFrame({KEY: p[KEY].iloc[0], "bin": p["bin"].to_numpy()[at], "time_seconds": p["time_seconds"].to_numpy()[at], "value": x[at], "prominence": prom})

    d = series.select(KEY, "bin", "time_seconds", F.col(value).alias("v"))
    return d.groupBy(KEY).applyInPandas(run, "stream_id string, bin long, time_seconds double, value double, prominence double")
