"""Queries of exports, zooming, per-clipper analytics and scalar correlation, on the tables of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkpulse.functions.timefmt import seconds_to_hms
from sparkpulse.operators import intervals as I
from sparkpulse.operators import overlap as O
from sparkpulse.operators import series as S
from sparkpulse.operators import text as T
from sparkpulse.operators import vectors as V

from . import catalogue as C
from .catalogue import query

LO, HI = 200_000.0, 1_500_000.0


def hms(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    return f"(CASE WHEN {s} >= 3600 THEN ({s} // 3600) || ':' || lpad(CAST({s} // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST({s} // 60 AS VARCHAR) END || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0'))"


def of(name: str, alias: str) -> str:
    return f"{alias} AS ({C._sql[name]})"


@query("WITH " + of("clip_timestamps", "c") + f" SELECT *, {hms('start_seconds')} AS start_hms, {hms('peak_seconds')} AS peak_hms, {hms('end_seconds')} AS end_hms FROM c")
def timestamps_table(spark, d):
    return S.with_hms(C.clip_timestamps(spark, d), "start_seconds", "peak_seconds", "end_seconds")


@query("WITH " + of("trend_deg3", "t") + ", " + of("rolling_sum", "r") + ", " + of("peaks", "p") + """ SELECT t.stream_id, r.time_seconds AS window_center_seconds, r.frequency AS window_frequency, t.trend, CAST(p.bin IS NOT NULL AS INTEGER) AS is_peak
FROM t JOIN r USING (stream_id, bin) LEFT JOIN p ON p.stream_id = t.stream_id AND p.bin = t.bin""")
def dashboard_sliding(spark, d):
    p = C.found(spark, d).select("stream_id", "bin", F.lit(1).alias("peak"))
    s = S.trend(C.roll(spark, d), 3).join(p, ["stream_id", "bin"], "left")
    return s.select("stream_id", F.col("time_seconds").alias("window_center_seconds"), F.col("frequency").alias("window_frequency"), F.round("trend", 4).alias("trend"), F.coalesce("peak", F.lit(0)).alias("is_peak"))


@query("WITH " + of("peak_sample_messages", "p") + f" SELECT *, {hms('peak_time_seconds')} AS peak_time_hms FROM p WHERE peak_time_seconds BETWEEN {LO} AND {HI}")
def dashboard_peaks(spark, d):
    p = S.between(C.peak_sample_messages(spark, d), LO, HI, "peak_time_seconds")
    return p.withColumn("peak_time_hms", seconds_to_hms("peak_time_seconds"))


CUT = f"z AS (SELECT stream_id, region_index, greatest(start_seconds, {LO}) AS start_seconds, least(end_seconds, {HI}) AS end_seconds FROM r WHERE end_seconds >= {LO} AND start_seconds <= {HI})"


@query("WITH " + of("classify_merge", "r") + ", " + CUT + f" SELECT *, {hms('start_seconds')} AS start_hms, {hms('end_seconds')} AS end_hms, end_seconds - start_seconds AS duration_seconds FROM z")
def dashboard_regions(spark, d):
    z = S.with_hms(I.within(C.classify_merge(spark, d), LO, HI, "start_seconds", "end_seconds"), "start_seconds", "end_seconds")
    return z.withColumn("duration_seconds", F.col("end_seconds") - F.col("start_seconds"))


@query("WITH " + of("classify_merge", "r") + ", pd AS (SELECT stream_id, greatest(0.0, start_seconds - 3600) AS s, end_seconds + 7200 AS e FROM r), " + C.union_sql("pd", "un") + f" SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY s) AS clip_index, s AS start_time_seconds, e AS end_time_seconds, {hms('s')} AS start_hms, {hms('e')} AS end_hms FROM un")
def region_clips(spark, d):
    r = C.classify_merge(spark, d).select("stream_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    c = I.region_clips(r, 3600.0, 7200.0).select("stream_id", "clip_index", F.col("start").alias("start_time_seconds"), F.col("end").alias("end_time_seconds"))
    return c.withColumn("start_hms", seconds_to_hms("start_time_seconds")).withColumn("end_hms", seconds_to_hms("end_time_seconds"))


CLIPPERS = ["0", "1", "2"]


def clipped(spark, d):
    """The peak clips, dealt to three clippers."""
    return C.peak_clips(spark, d).withColumn("clipper", (F.col("bin") % 3).cast("string"))


@query("WITH RECURSIVE " + C.SIDES + ", cc AS (SELECT stream_id || '#' || (bin % 3) AS stream_id, s, e FROM cl), " + C.union_sql("cc", "uc") + """, ov AS (SELECT r.stream_id, r.id, split_part(u.stream_id, '#', 2) AS k, sum(greatest(0.0, least(r.e, u.e) - greatest(r.s, u.s))) / any_value(r.e - r.s) AS f
 FROM rv r JOIN uc u ON split_part(u.stream_id, '#', 1) = r.stream_id GROUP BY 1, 2, 3) SELECT r.stream_id, r.id, """ + ", ".join(f"round(coalesce(max(f) FILTER (WHERE k = '{k}'), 0.0), 4) AS coverage_frac_{k}" for k in CLIPPERS) + " FROM rv r LEFT JOIN ov USING (stream_id, id) GROUP BY 1, 2")
def coverage_per_clipper(spark, d):
    return O.coverage_by(C.two_sides(spark, d)[0], clipped(spark, d), "clipper", CLIPPERS, 86400.0)


@query("WITH RECURSIVE " + C.SIDES + ", du AS (SELECT stream_id, max(time_seconds) + 60 AS t FROM roll GROUP BY 1), c AS (SELECT stream_id, sum(e - s) AS c FROM un GROUP BY 1), r AS (SELECT stream_id, sum(e - s) AS r FROM rv GROUP BY 1) SELECT stream_id, t AS stream_duration_s, round(coalesce(c, 0.0), 1) AS total_clipped_s, round(100 * coalesce(c, 0.0) / t, 2) AS clipped_pct_of_stream, round(coalesce(r, 0.0), 1) AS total_region_s, round(100 * coalesce(r, 0.0) / t, 2) AS region_pct_of_stream FROM du LEFT JOIN c USING (stream_id) LEFT JOIN r USING (stream_id)")
def clipped_share(spark, d):
    r, c = C.two_sides(spark, d)
    ends = C.roll(spark, d).groupBy("stream_id").agg((F.max("time_seconds") + 60).alias("stream_duration_s"))
    return O.clipped_share(c, r, ends)


@query("WITH RECURSIVE " + C.CLIPS + ", cc AS (SELECT stream_id || '#' || (bin % 3) AS stream_id, s, e FROM cl), " + C.union_sql("cc", "uc") + ", n AS (SELECT stream_id, sum(e - s) AS net_s FROM uc GROUP BY 1), t AS (SELECT stream_id, count(*) AS n_segments, sum(e - s) AS total_s FROM cc GROUP BY 1) SELECT split_part(stream_id, '#', 1) AS stream_id, split_part(stream_id, '#', 2) AS clipper, n_segments, total_s, net_s FROM t JOIN n USING (stream_id)")
def highlight_summary(spark, d):
    return O.highlight_summary(clipped(spark, d), "clipper")


@query("WITH RECURSIVE " + C.CLIPS + ", " + C.union_sql("cl", "un") + ", n AS (SELECT stream_id, sum(e - s) AS stream_net_s FROM un GROUP BY 1), t AS (SELECT stream_id, sum(e - s) AS reel_s FROM cl GROUP BY 1) SELECT stream_id, reel_s, stream_net_s, round(stream_net_s / greatest(1.0, reel_s), 6) AS inflation FROM t JOIN n USING (stream_id)")
def inflation_ratio(spark, d):
    return O.inflation(C.peak_clips(spark, d)).withColumn("inflation", F.round("inflation", 6))


@query("WITH RECURSIVE " + C.SIDES + f" SELECT stream_id, id, greatest(s, {LO}) AS \"start\", least(e, {HI}) AS \"end\" FROM rv WHERE e >= {LO} AND s <= {HI}")
def regions_in_range(spark, d):
    return I.within(C.two_sides(spark, d)[0], LO, HI)


@query("WITH " + C.HIST + f" SELECT stream_id, bin, cnt FROM hist WHERE (bin + 0.5) * 3600 BETWEEN {LO} AND {HI}")
def hist_in_range(spark, d):
    return S.centre_between(C.hist(spark, d), C.STEP, LO, HI).select("stream_id", "bin", "cnt")


@query("WITH " + C.RMS + " SELECT stream_id, frame, round(ln(1 + rms), 6) AS value FROM rm")
def log_envelope(spark, d):
    return C.rms(spark, d).select("stream_id", "frame", F.round(F.log1p("rms"), 6).alias("value"))


@query("WITH " + C.ROLL + ", e AS (SELECT stream_id, min(time_seconds) AS a, max(time_seconds) AS b FROM roll GROUP BY 1) SELECT stream_id, CAST(k AS INTEGER) AS tick, round(a + (b - a) * k / 7, 4) AS at FROM e, range(8) t(k)")
def axis_ticks(spark, d):
    return S.ticks(C.roll(spark, d)).withColumn("at", F.round("at", 4))


FIRST, SIZE = 100, 24


@query("WITH " + C.HIST + f""", v AS (SELECT stream_id, bin, ln(1 + cnt) AS v FROM hist), t AS (SELECT stream_id, bin - {FIRST} AS i, v FROM v WHERE bin >= {FIRST} AND bin < {FIRST + SIZE}),
x AS (SELECT a.stream_id, a.bin, avg(b.v) AS mx, stddev_pop(b.v) AS sx, avg(t.v) AS mt, stddev_pop(t.v) AS st, avg(b.v * t.v) AS m, count(*) AS n FROM v a JOIN v b ON b.stream_id = a.stream_id AND b.bin >= a.bin AND b.bin < a.bin + {SIZE} JOIN t ON t.stream_id = a.stream_id AND t.i = b.bin - a.bin GROUP BY 1, 2)
SELECT stream_id, bin, round(CASE WHEN sx < 1e-9 OR st < 1e-9 THEN 0.0 ELSE greatest(-1.0, least(1.0, (m - mx * mt) / (sx * st))) END, 4) + 0.0 AS ncc FROM x WHERE n = {SIZE}""")
def envelope_ncc(spark, d):
    """The log-compressed counts of each stream against a day of its own, bins 100 to 123, as template."""
    v = C.hist(spark, d).select("stream_id", "bin", F.log1p(F.col("cnt").cast("double")).alias("value"))
    t = v.where((F.col("bin") >= FIRST) & (F.col("bin") < FIRST + SIZE)).groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "value"))), lambda x: x["value"]).alias("template")).where(F.size("template") == SIZE)  # SIZE values
    return V.envelope_ncc(v, t, SIZE).select("stream_id", "bin", (F.round("ncc", 4) + 0.0).alias("ncc"))


def ascii_sql(x: str) -> str:
    for a, b in T.ASCII.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query("SELECT doc_id, " + ascii_sql("text") + " AS text FROM documents WHERE text IS NOT NULL")
def ascii_text(spark, d):
    return C.parquet(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.to_ascii(F.col("text")).alias("text"))
