"""Interval algebra: unions, overlaps, flags, nearest edges, clip padding and snapping, reel scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY


def union(iv: DataFrame, *, max_gap: float = 0.0) -> DataFrame:
    """stream_id, start, end: touching intervals (or those up to max_gap apart) merged."""
    w = Window.partitionBy(KEY).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = iv.select(KEY, "start", "end").withColumn("new", F.when(F.col("start") - before <= max_gap, 0).otherwise(1))
    d = d.withColumn("g", F.sum("new").over(w))
    return d.groupBy(KEY, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def range_join(left: DataFrame, right: DataFrame, width: float, how: str = "inner") -> DataFrame:
    """Pairs of intervals (start, end) and (start2, end2) of a stream that overlap strictly, by an equi-join on time buckets of
    the given width; each pair comes once, in the bucket where the later one starts.  Left joins need left's ``id``."""
    a = left.withColumn("__b", _buckets(F.col("start"), F.col("end"), width))
    b = right.withColumn("__b", _buckets(F.col("start2"), F.col("end2"), width))
    first = F.floor(F.greatest(F.col("start"), F.col("start2")) / width) == F.col("__b")
    inner = a.join(b, [KEY, "__b"]).where((F.col("start2") < F.col("end")) & (F.col("end2") > F.col("start")) & first).drop("__b")
    if how == "inner":
        return inner
    return left.join(inner.select(KEY, "id", *(c for c in right.columns if c != KEY)), [KEY, "id"], "left")


def overlap(left: DataFrame, right: DataFrame, width: float = 600.0) -> DataFrame:
    """left (stream_id, id, start, end, ...) with ``covered``: seconds that right's intervals share with it, summed."""
    r = right.select(KEY, F.col("start").alias("start2"), F.col("end").alias("end2"))
    part = F.least("end", "end2") - F.greatest("start", "start2")
    got = range_join(left.select(KEY, "id", "start", "end"), r, width).groupBy(KEY, "id").agg(F.sum(part).alias("covered"))
    return left.join(got, [KEY, "id"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def overlap_sums(left: DataFrame, right: DataFrame, width: float = 600.0) -> DataFrame:
    """overlap() without making pairs, for many intervals that overlap many: right's total before a time t is the sum of t - start
    over its starts up to t less that of t - end over its ends, so ``covered`` is the total at end less that at start.

    Edges are summed up by time first, so windows hold a row per time and not per edge: over time buckets of the given width, then
    within a bucket.  Each row of left looks its two times up.  Right's intervals without both ends or with an end not above its
    start share nothing; nor do left's."""
    both = lambda d, first, last: d.where(F.col("end") > F.col("start")).select(KEY, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(first).alias("v")), F.struct(F.col("end").alias("at"), F.lit(last).alias("v")))).alias("x")).select(KEY, "x.*")
    d = both(right, 1.0, -1.0).unionByName(both(left, 0.0, 0.0)).groupBy(KEY, "at").agg(F.sum("v").alias("n"), F.sum(F.col("v") * F.col("at")).alias("s"))
    d = d.withColumn("__b", F.floor(F.col("at") / width))
    before = Window.partitionBy(KEY).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(KEY, "__b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    base = sums.select(KEY, "__b", F.coalesce(F.sum("n").over(before), F.lit(0.0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"))
    within = Window.partitionBy(KEY, "__b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(KEY, "__b", "at", F.sum("n").over(within).alias("n1"), F.sum("s").over(within).alias("s1")).join(base, [KEY, "__b"])
    total = (F.col("n0") + F.col("n1")) * F.col("at") - F.col("s0") - F.col("s1")
    look = lambda edge: d.select(KEY, F.col("at").alias(edge), total.alias(f"__{edge}"))
    got = left.join(look("start"), [KEY, "start"], "left").join(look("end"), [KEY, "end"], "left")
    covered = F.when(F.col("end") > F.col("start"), F.col("__end") - F.col("__start"))
    return got.select(*left.columns, F.coalesce(covered, F.lit(0.0)).alias("covered"))


def flags(points: DataFrame, iv: DataFrame, half: float = 5.0, width: float = 600.0) -> DataFrame:
    """points (stream_id, id, time_seconds, ...) with ``flag``: 1 if [time - half, time + half) overlaps an interval strictly."""
    p = points.withColumn("start", F.col("time_seconds") - half).withColumn("end", F.col("time_seconds") + half)
    r = iv.select(KEY, F.col("start").alias("start2"), F.col("end").alias("end2"))
    hit = range_join(p.select(KEY, "id", "start", "end"), r, width).select(KEY, "id").distinct().withColumn("flag", F.lit(1))
    return points.join(hit, [KEY, "id"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def messages_near(points: DataFrame, messages: DataFrame, *, margin: float = 5.0, limit: int | None = 5) -> DataFrame:
    """stream_id, id, r, seconds, author, message: each point's first messages (by row_id) within margin, ends included."""
    width = max(2 * margin, 1.0)
    p = points.select(KEY, "id", "time_seconds").withColumn("__b", F.explode(F.sequence(F.floor((F.col("time_seconds") - margin) / width), F.floor((F.col("time_seconds") + margin) / width))))
    m = messages.withColumn("__b", F.floor(F.col("seconds") / width))
    j = p.join(m, [KEY, "__b"]).where(F.abs(F.col("seconds") - F.col("time_seconds")) <= margin)
    j = j.withColumn("r", F.row_number().over(Window.partitionBy(KEY, "id").orderBy("row_id")))
    return (j if limit is None else j.where(F.col("r") <= limit)).select(KEY, "id", "r", "seconds", "author", "message")


def sample_messages(points: DataFrame, messages: DataFrame, *, margin: float = 10.0, count: int = 3, cut: int = 50) -> DataFrame:
    """points with sample_messages: the first messages near each, cut and joined by "; " (empty without any)."""
    near = messages_near(points, messages, margin=margin, limit=count)
    s = near.groupBy(KEY, "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.substring("message", 1, cut).alias("m")))), lambda x: x["m"]), "; ").alias("sample_messages"))
    return points.join(s, [KEY, "id"], "left").withColumn("sample_messages", F.coalesce("sample_messages", F.lit("")))


def preview(text: Column, cut: int = 100) -> Column:
    return F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit("..."))).otherwise(text)


def clips(points: DataFrame, before: float = 30, after: float = 30) -> DataFrame:
    """points with start and end around time_seconds, start not below 0."""
    return points.withColumn("start", F.greatest(F.lit(0.0), F.col("time_seconds") - before)).withColumn("end", F.col("time_seconds") + after)


def nearest(points: DataFrame, targets: DataFrame, max_distance: float | None, out: str) -> DataFrame:
    """points (stream_id, id, time_seconds, ...) with the nearest target (stream_id, at, order) in ``out``; ties by order; null if
    none is within max_distance.  Without max_distance the neighbours on both sides are looked up by windows."""
    p = points.select(KEY, "id", "time_seconds")
    if max_distance is None:
        both = p.select(KEY, F.col("time_seconds").alias("at"), F.col("id"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("long").alias("o")).unionByName(targets.select(KEY, "at", F.lit(None).cast(dict(p.dtypes)["id"]).alias("id"), F.col("at").alias("t"), F.col("order").cast("long").alias("o")))
        w = Window.partitionBy(KEY).orderBy("at")
        pick = F.when(F.col("t").isNotNull(), F.struct(F.col("t"), F.negative("o").alias("o")))
        lo = F.max(pick).over(w.rangeBetween(Window.unboundedPreceding, 0))
        hi = F.min(F.when(F.col("t").isNotNull(), F.struct("t", "o"))).over(w.rangeBetween(0, Window.unboundedFollowing))
        n = both.select("*", lo.alias("lo"), hi.alias("hi")).where("id is not null")
        better = (F.col("at") - F.col("lo.t") < F.col("hi.t") - F.col("at")) | ((F.col("at") - F.col("lo.t") == F.col("hi.t") - F.col("at")) & (-F.col("lo.o") <= F.col("hi.o")))
        got = n.select(KEY, "id", F.when(F.col("hi").isNull() | better, F.col("lo.t")).otherwise(F.col("hi.t")).alias(out))
    else:
        width = max(max_distance, 1.0)
        b = p.withColumn("__b", F.explode(F.sequence(F.floor((F.col("time_seconds") - max_distance) / width), F.floor((F.col("time_seconds") + max_distance) / width))))
        j = b.join(targets.withColumn("__b", F.floor(F.col("at") / width)), [KEY, "__b"])
        dist = F.abs(F.col("at") - F.col("time_seconds"))
        got = j.where(dist <= max_distance).groupBy(KEY, "id").agg(F.min_by("at", F.struct(dist, F.col("order"))).alias(out))
    return points.join(got, [KEY, "id"], "left")


def snap(rough: DataFrame, sentences: DataFrame, silences: DataFrame | None = None, *, max_snap: float = 3.0, tolerance: float = 1.0, expand: bool = False) -> DataFrame:
    """rough clips (stream_id, id, start, end) with refined start and end: to the nearest sentence boundary, then to the nearest
    silence edge; both revert if the clip gets empty or shorter than half a second."""

    def moved(clips: DataFrame, edge: str) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(KEY).orderBy("start", "end"))
        at = sentences.select(KEY, F.col(edge).alias("at"), order.alias("order"))
        p = nearest(clips.select(KEY, "id", F.col(edge).alias("time_seconds")), at, max_snap, "near")
        if expand:
            p = nearest(p, at, None, "far")
            p = p.withColumn("near", F.coalesce("near", "far"))
        p = p.select(KEY, "id", F.coalesce("near", "time_seconds").alias("time_seconds"))
        if silences is not None:
            other = "end" if edge == "start" else "start"
            p = nearest(p, silences.select(KEY, F.col(other).alias("at"), order.alias("order")), tolerance, "quiet").select(KEY, "id", F.coalesce("quiet", "time_seconds").alias("time_seconds"))
        return p.withColumnRenamed("time_seconds", f"new_{edge}")

    d = rough.join(moved(rough, "start"), [KEY, "id"]).join(moved(rough, "end"), [KEY, "id"])
    ok = F.col("new_end") - F.col("new_start") >= 0.5
    return d.withColumn("start", F.when(ok, F.col("new_start")).otherwise(F.col("start"))).withColumn("end", F.when(ok, F.col("new_end")).otherwise(F.col("end"))).drop("new_start", "new_end")


def reel_script(iv: DataFrame, media: str, output: str = "reel.mp4") -> DataFrame:
    """One command per stream that trims its clips in order and concatenates them."""
    d = iv.withColumn("i", F.row_number().over(Window.partitionBy(KEY).orderBy("start", "end")) - 1)
    num = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    i = F.col("i").cast("string")
    part = F.concat(F.lit("[0:v]trim=start="), num("start"), F.lit(":end="), num("end"), F.lit(",setpts=PTS-STARTPTS[v"), i, F.lit("];[0:a]atrim=start="), num("start"), F.lit(":end="), num("end"), F.lit(",asetpts=PTS-STARTPTS[a"), i, F.lit("];"))
    d = d.withColumn("part", part).withColumn("label", F.concat(F.lit("[v"), i, F.lit("][a"), i, F.lit("]")))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda x: x[c]), "")
    g = d.groupBy(KEY).agg(joined("part").alias("p"), joined("label").alias("l"), F.count("*").alias("n"))
    return g.select(KEY, F.concat(F.lit(f'ffmpeg -i "{media}" -filter_complex "'), "p", "l", F.lit("concat=n="), F.col("n").cast("string"), F.lit(f':v=1:a=1[v][a]" -map "[v]" -map "[a]" "{output}"')).alias("script"))


def within(iv: DataFrame, lo: float | None = None, hi: float | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that touch [lo, hi], cut to it; a bound that is None is none."""
    if lo is not None:
        iv = iv.where(F.col(end) >= lo).withColumn(start, F.greatest(F.col(start), F.lit(float(lo))))
    if hi is not None:
        iv = iv.where(F.col(start) <= hi).withColumn(end, F.least(F.col(end), F.lit(float(hi))))
    return iv


def region_clips(regions: DataFrame, before: float, after: float) -> DataFrame:
    """Regions (start, end) padded, not below 0, and merged where they touch: clip_index, start, end per stream."""
    padded = regions.select(KEY, F.greatest(F.lit(0.0), F.col("start") - before).alias("start"), (F.col("end") + after).alias("end"))
    order = Window.partitionBy(KEY).orderBy("start")  # a row per clip
    return union(padded).withColumn("clip_index", F.row_number().over(order).cast("long"))
