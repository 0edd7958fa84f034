"""Zero-filled histograms, hopping sums, polynomial trend and trend-normalised signals, for many streams at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkpulse.functions.timefmt import seconds_to_hms

KEY = "stream_id"


def histogram(messages: DataFrame, step: int) -> DataFrame:
    """stream_id, bin, cnt: bins of ``step`` seconds from 0 on, the last one closed, empty ones 0; negative times are dropped."""
    if step <= 0:
        raise ValueError("step must be positive")
    m = messages.where("seconds >= 0")
    counts = m.groupBy(KEY, "seconds").agg(F.count("*").alias("c"))
    ends = counts.groupBy(KEY).agg(F.ceil(F.max("seconds") / step).alias("n")).where("n > 0")
    bins = counts.join(ends, KEY).groupBy(KEY, F.least(F.floor(F.col("seconds") / step), F.col("n") - 1).alias("bin")).agg(F.sum("c").alias("cnt"))
    grid = ends.select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"))
    return grid.join(bins, [KEY, "bin"], "left").select(KEY, "bin", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def window_bins(step: int, window: int) -> int:
    w = round(window / step)
    if w < 1:
        raise ValueError("the window is shorter than a bin")
    return w


def sliding(hist: DataFrame, step: int, window: int) -> DataFrame:
    """stream_id, bin, time_seconds (the window's centre) and frequency of every whole window."""
    w = window_bins(step, window)
    frame = Window.partitionBy(KEY).orderBy("bin").rowsBetween(0, w - 1)
    d = hist.select(KEY, "bin", F.sum("cnt").over(frame).alias("frequency"), F.count("*").over(frame).alias("k")).where(F.col("k") == w)
    return d.select(KEY, "bin", (F.col("bin") * step + F.lit(w * step / 2)).alias("time_seconds"), F.col("frequency").cast("double").alias("frequency"))


def trend(series: DataFrame, degree: int, value: str = "frequency", out: str = "trend") -> DataFrame:
    """series with its least-squares polynomial of bin, by Forsythe's orthogonal recurrence: each degree is one aggregate over
    the stream.  Fewer than degree + 1 points: zeros.  Degree 0 or less: null."""
    if degree <= 0:
        return series.withColumn(out, F.lit(None).cast("double"))
    all_ = Window.partitionBy(KEY)
    total = lambda c: F.sum(c).over(all_)
    y = F.col(value)
    d = series.withColumn("__n", F.count("*").over(all_)).withColumn("__half", F.greatest((F.max("bin").over(all_) - F.min("bin").over(all_)) / 2, F.lit(0.5)))
    d = d.withColumn("__u", (F.col("bin") - F.avg("bin").over(all_)) / F.col("__half"))
    d = d.withColumn("__p0", F.lit(1.0)).withColumn("__p1", F.col("__u") - F.avg("__u").over(all_))
    d = d.withColumn("__q0", F.col("__n").cast("double")).withColumn("__q1", total(F.col("__p1") ** 2))
    for k in range(1, degree):
        p, q = F.col(f"__p{k}"), F.col(f"__q{k}")
        a = total(F.col("__u") * p * p) / F.nullif(q, F.lit(0.0))
        d = d.withColumn("__a", F.coalesce(a, F.lit(0.0)))
        d = d.withColumn(f"__p{k + 1}", (F.col("__u") - F.col("__a")) * p - F.coalesce(q / F.nullif(F.col(f"__q{k - 1}"), F.lit(0.0)), F.lit(0.0)) * F.col(f"__p{k - 1}"))
        d = d.withColumn(f"__q{k + 1}", total(F.col(f"__p{k + 1}") ** 2))
    fit: Column = F.lit(0.0)
    for k in range(degree + 1):
        p, q = F.col(f"__p{k}"), F.col(f"__q{k}")
        fit = fit + F.coalesce(total(y * p) / F.nullif(q, F.lit(0.0)), F.lit(0.0)) * p
    d = d.withColumn(out, F.when(F.col("__n") < degree + 1, F.lit(0.0)).otherwise(fit))
    return d.drop(*(c for c in d.columns if c.startswith("__")))


def normalized(series: DataFrame, degree: int = 3) -> DataFrame:
    """series with trend and normalized = frequency / max(trend, floor); without a degree the raw signal."""
    d = trend(series, degree)
    if degree <= 0:
        return d.withColumn("normalized", F.col("frequency"))
    floor = F.greatest(F.lit(1e-6), 0.1 * F.avg("trend").over(Window.partitionBy(KEY)))
    return d.withColumn("normalized", F.col("frequency") / F.greatest(F.col("trend"), floor))


def between(series: DataFrame, start: float | None = None, end: float | None = None, time: str = "time_seconds") -> DataFrame:
    """Inclusive time range; apply it after trends are worked out."""
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            series = series.where(getattr(F.col(time), op)(bound))
    return series


def with_hms(df: DataFrame, *times: str) -> DataFrame:
    for t in times or ("time_seconds",):
        df = df.withColumn(t.replace("_seconds", "_hms") if t.endswith("_seconds") else f"{t}_hms", seconds_to_hms(t))
    return df


def centre_between(hist: DataFrame, step: int, start: float = 0, end: float = 0) -> DataFrame:
    """Bins whose centre lies in the range; a bound of 0 is none."""
    centre = (F.col("bin") + 0.5) * step
    for bound, keep in ((start, centre >= start), (end, centre <= end)):
        if bound:
            hist = hist.where(keep)
    return hist


def ticks(series: DataFrame, n: int = 8, time: str = "time_seconds") -> DataFrame:
    """stream_id, tick, at: n evenly spaced points from the first time to the last."""
    ends = series.groupBy(KEY).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tick")
    return ends.select(KEY, "a", "b", k).select(KEY, "tick", (F.col("a") + (F.col("b") - F.col("a")) * F.col("tick") / max(1, n - 1)).alias("at"))
