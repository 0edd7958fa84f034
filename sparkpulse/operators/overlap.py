"""Overlap analytics: coverage, recall and precision, correlation, quantile buckets, metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkpulse.functions.arrays import corr

from . import intervals as I
from .series import KEY

LEVELS = (0, 25, 50, 75)


def coverage(regions: DataFrame, clips: DataFrame, series: DataFrame | None = None, value: str = "normalized", width: float = 600.0) -> DataFrame:
    """regions (stream_id, id, start, end) with covered, coverage_frac, covered_at_* flags, and mean and max of the series inside."""
    d = I.overlap(regions.where("end > start"), I.union(clips), width)
    frac = F.col("covered") / (F.col("end") - F.col("start"))
    d = d.withColumn("coverage_frac", F.round(frac, 4))
    for p in LEVELS:
        d = d.withColumn(f"covered_at_{p}pct", F.when(frac > 0 if p == 0 else frac >= p / 100, 1).otherwise(0))
    if series is not None:
        s = series.select(KEY, F.col("time_seconds").alias("t"), F.col(value).alias("v")).withColumn("__b", F.floor(F.col("t") / width))
        r = regions.select(KEY, "id", "start", "end").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
        e = r.join(s, [KEY, "__b"]).where("t between start and end").groupBy(KEY, "id").agg(F.round(F.avg("v"), 4).alias("mean_engagement"), F.round(F.max("v"), 4).alias("max_engagement"))
        d = d.join(e, [KEY, "id"], "left")
    return d


def recall_precision(regions: DataFrame, clips: DataFrame, width: float = 600.0) -> DataFrame:
    """Per stream: region_seconds, clipped_seconds, both_seconds, recall, precision; both sides unioned."""
    named = lambda d: I.union(d).withColumn("id", F.row_number().over(Window.partitionBy(KEY).orderBy("start")))
    r, c = named(regions), named(clips)
    both = I.overlap(r, c, width).groupBy(KEY).agg(F.sum(F.col("end") - F.col("start")).alias("region_seconds"), F.sum("covered").alias("both_seconds"))
    total = c.groupBy(KEY).agg(F.sum(F.col("end") - F.col("start")).alias("clipped_seconds"))
    d = both.join(total, KEY, "left")
    return d.withColumn("recall", F.round(F.col("both_seconds") / F.col("region_seconds"), 4)).withColumn("precision", F.round(F.col("both_seconds") / F.col("clipped_seconds"), 4))


def pointbiserial(df: DataFrame, flag: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, r, t and two-sided p of a 0/1 flag against a value; null unless over 10 rows and over 5 in each class."""
    g = df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.sum(flag).cast("long").alias("ones"), corr(F.col(flag).cast("double"), F.col(value).cast("double")).alias("r0"))
    ok = (F.col("n") > 10) & (F.col("ones") > 5) & (F.col("n") - F.col("ones") > 5)
    v = F.col("n") - 2
    g = g.withColumn("r", F.when(ok, F.col("r0"))).withColumn("t", F.col("r") * F.sqrt(v / (1 - F.col("r") ** 2)))
    p = F.when(F.col("t").isNotNull(), F.java_method(F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"), (v / (v + F.coalesce("t", F.lit(0.0)) ** 2)).cast("double"), (v / 2).cast("double"), F.lit(0.5).cast("double")).cast("double"))
    return g.withColumn("p", p).drop("r0", "ones")


def quantile_buckets(df: DataFrame, value: str, flag: str, n: int = 15) -> DataFrame:
    """bucket, mean of value, mean of flag and count between the distinct quantile edges of value."""
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*(F.lit(i / n) for i in range(n + 1))))).alias("e"))
    d = df.join(F.broadcast(edges))  # one row
    b = F.size(F.filter("e", lambda x: x <= F.col(value))) - 1
    d = d.where(F.size("e") >= 4).withColumn("bucket", F.least(F.greatest(b, F.lit(0)), F.size("e") - 2))
    return d.groupBy("bucket").agg(F.avg(value).alias("mean_value"), F.avg(F.col(flag).cast("double")).alias("share"), F.count("*").alias("n"))


def unit_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts of values in [0, 1] by bins, the last one closed."""
    d = df.where(F.col(value).between(0, 1)).select(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("bin"))
    return d.groupBy("bin").agg(F.count("*").alias("n"))


def metrics_long(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.select(KEY, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select(KEY, "m.*")


def metrics_wide(long: DataFrame, names: list[str]) -> DataFrame:
    return long.groupBy(KEY).pivot("metric", names).agg(F.first("value"))


def coverage_by(regions: DataFrame, clips: DataFrame, by: str, names: list[str], width: float = 600.0) -> DataFrame:
    """regions (stream_id, id, start, end) with coverage_frac_<name>: the share that the clips of each value of ``by`` cover."""
    joint = clips.withColumn(KEY, F.struct(F.col(KEY).alias("s"), F.col(by).cast("string").alias("by")))
    c = I.union(joint).select(F.col(f"{KEY}.s").alias(KEY), F.col(f"{KEY}.by").alias("by"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    part = F.least("end", "end2") - F.greatest("start", "start2")
    r = regions.where("end > start")
    got = I.range_join(r.select(KEY, "id", "start", "end"), c, width).groupBy(KEY, "id").pivot("by", names).agg(F.sum(part))
    share = lambda n: F.round(F.coalesce(F.col(n), F.lit(0.0)) / (F.col("end") - F.col("start")), 4).alias(f"coverage_frac_{n[:20]}")
    return r.join(got, [KEY, "id"], "left").select(KEY, "id", *map(share, names))


def clipped_share(clips: DataFrame, regions: DataFrame, durations: DataFrame) -> DataFrame:
    """Per stream of durations (stream_id, stream_duration_s): seconds clipped and in regions (unions), and their percentages."""
    total = lambda d, n: I.union(d).groupBy(KEY).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    d = durations.join(total(clips, "c"), KEY, "left").join(total(regions, "r"), KEY, "left").na.fill(0.0, ["c", "r"])
    pct = lambda n: F.round(100 * F.col(n) / F.col("stream_duration_s"), 2)
    return d.select(KEY, "stream_duration_s", F.round("c", 1).alias("total_clipped_s"), pct("c").alias("clipped_pct_of_stream"), F.round("r", 1).alias("total_region_s"), pct("r").alias("region_pct_of_stream"))


def highlight_summary(segments: DataFrame, by: str = "highlight_file") -> DataFrame:
    """Per highlight of a stream: its segments (start, end), their seconds, and the seconds of the stream that they cover once."""
    sums = segments.groupBy(KEY, by).agg(F.count("*").alias("n_segments"), F.sum(F.col("end") - F.col("start")).alias("total_s"))
    joint = segments.withColumn(KEY, F.struct(F.col(KEY).alias("s"), F.col(by).alias("by")))
    net = I.union(joint).groupBy(KEY).agg(F.sum(F.col("end") - F.col("start")).alias("net_s")).select(F.col(f"{KEY}.s").alias(KEY), F.col(f"{KEY}.by").alias(by), "net_s")
    return sums.join(net, [KEY, by])


def inflation(segments: DataFrame) -> DataFrame:
    """Per stream: seconds covered once, over the seconds of all its reels' segments (1 at least)."""
    reel = segments.groupBy(KEY).agg(F.sum(F.col("end") - F.col("start")).alias("reel_s"))
    net = I.union(segments).groupBy(KEY).agg(F.sum(F.col("end") - F.col("start")).alias("stream_net_s"))
    return reel.join(net, KEY).withColumn("inflation", F.col("stream_net_s") / F.greatest(F.lit(1.0), F.col("reel_s")))
