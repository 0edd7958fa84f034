"""The queries of the engine's own operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpulse.functions.arrays import corr
from sparkpulse.functions.timefmt import parse_time, seconds_to_hms
from sparkpulse.operators import intervals as I
from sparkpulse.operators import overlap as O
from sparkpulse.operators import peaks as P
from sparkpulse.operators import segments as G
from sparkpulse.operators import series as S
from sparkpulse.operators import text as T
from sparkpulse.operators import vectors as V
from sparkpulse.sources import readers as R
from sparkpulse.streaming import live

#: Events are sparse, so times are scaled up: bins of an hour, windows of six.
STEP, WINDOW, PROMINENCE, MARGIN, PAD = 3600, 21600, 5.0, 7200.0, 10800.0
_q: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _q[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def hist(spark, d):
    return S.histogram(R.events(spark, d), STEP)


def roll(spark, d):
    return S.sliding(hist(spark, d), STEP, WINDOW)


def norm(spark, d):
    return S.normalized(roll(spark, d), 3)


def parquet(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


MSG = """msg AS (SELECT event_type AS stream_id, event_id AS row_id, CAST(user_id AS VARCHAR) AS author, event_type || ' ' || props AS message,
  CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS seconds, value FROM events)"""
HIST = MSG + """, nb AS (SELECT stream_id, CAST(ceil(max(seconds) / 3600.0) AS BIGINT) AS n FROM msg WHERE seconds >= 0 GROUP BY 1),
cnt AS (SELECT m.stream_id, least(seconds // 3600, n - 1) AS bin, count(*) AS c FROM msg m JOIN nb USING (stream_id) WHERE seconds >= 0 GROUP BY 1, 2),
grid AS (SELECT stream_id, unnest(range(n)) AS bin FROM nb),
hist AS (SELECT g.stream_id, g.bin, CAST(coalesce(c, 0) AS BIGINT) AS cnt FROM grid g LEFT JOIN cnt USING (stream_id, bin))"""
ROLL = HIST + """, roll AS (SELECT stream_id, bin, CAST(bin * 3600 + 10800 AS DOUBLE) AS time_seconds, CAST(s AS DOUBLE) AS frequency FROM (
  SELECT stream_id, bin, sum(cnt) OVER w AS s, count(*) OVER w AS k FROM hist WINDOW w AS (PARTITION BY stream_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE k = 6)"""


def trend_sql(degree: int) -> str:
    out = ROLL + """, t0 AS (SELECT *, (bin - avg(bin) OVER s) / ((max(bin) OVER s - min(bin) OVER s) / 2.0) AS u, count(*) OVER s AS n FROM roll WINDOW s AS (PARTITION BY stream_id)),
t1 AS (SELECT *, CAST(n AS DOUBLE) AS q0, CAST(1 AS DOUBLE) AS p0, u - avg(u) OVER s AS p1 FROM t0 WINDOW s AS (PARTITION BY stream_id)),
r1 AS (SELECT *, sum(p1 * p1) OVER s AS q1 FROM t1 WINDOW s AS (PARTITION BY stream_id))"""
    for k in range(1, degree):
        out += f""", t{k + 1} AS (SELECT *, (u - sum(u * p{k} * p{k}) OVER s / q{k}) * p{k} - q{k} / q{k - 1} * p{k - 1} AS p{k + 1} FROM r{k} WINDOW s AS (PARTITION BY stream_id)),
r{k + 1} AS (SELECT *, sum(p{k + 1} * p{k + 1}) OVER s AS q{k + 1} FROM t{k + 1} WINDOW s AS (PARTITION BY stream_id))"""
    fit = " + ".join(f"sum(frequency * p{k}) OVER s / q{k} * p{k}" for k in range(degree + 1))
    return out + f", tr AS (SELECT stream_id, bin, time_seconds, frequency, {fit} AS trend FROM r{degree} WINDOW s AS (PARTITION BY stream_id))"


NORM = trend_sql(3) + ", nm AS (SELECT *, frequency / greatest(trend, greatest(1e-6, 0.1 * avg(trend) OVER (PARTITION BY stream_id))) AS normalized FROM tr)"
MAXIMA = ROLL + """, ru AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY bin) AS run FROM (
  SELECT *, CASE WHEN lag(frequency) OVER (PARTITION BY stream_id ORDER BY bin) = frequency THEN 0 ELSE 1 END AS new FROM roll)),
rn AS (SELECT stream_id, run, min(bin) AS lo, max(bin) AS hi, min(frequency) AS v FROM ru GROUP BY 1, 2),
nx AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM rn WINDOW w AS (PARTITION BY stream_id ORDER BY run)),
mx AS (SELECT stream_id, (lo + hi) // 2 AS bin, v AS value FROM nx WHERE v > b AND v > a)"""
PEAKS = MAXIMA.replace("WITH ", "") + """, rk AS (SELECT stream_id, list(bin ORDER BY value DESC, bin DESC) AS bs FROM mx GROUP BY 1),
gr(stream_id, bs, i, acc) AS (SELECT stream_id, bs, 1, CAST([] AS BIGINT[]) FROM rk UNION ALL
  SELECT stream_id, bs, i + 1, CASE WHEN len(list_filter(acc, lambda q: abs(q - bs[i]) < 3)) > 0 THEN acc ELSE list_append(acc, bs[i]) END FROM gr WHERE i <= len(bs)),
sp AS (SELECT g.stream_id, unnest(acc) AS bin FROM gr g WHERE i = len(bs) + 1),
pv AS (SELECT s.stream_id, s.bin, r.time_seconds, r.frequency AS value FROM sp s JOIN roll r USING (stream_id, bin)),
pl AS (SELECT p.stream_id, p.bin, max(r.bin) FILTER (WHERE r.bin < p.bin) AS l, min(r.bin) FILTER (WHERE r.bin > p.bin) AS h FROM pv p JOIN roll r ON r.stream_id = p.stream_id AND r.frequency > p.value GROUP BY 1, 2),
pr AS (SELECT p.stream_id, p.bin, any_value(p.time_seconds) AS time_seconds, any_value(p.value) AS value,
  any_value(p.value) - greatest(min(r.frequency) FILTER (WHERE r.bin <= p.bin), min(r.frequency) FILTER (WHERE r.bin >= p.bin)) AS prominence
  FROM pv p LEFT JOIN pl USING (stream_id, bin) JOIN roll r ON r.stream_id = p.stream_id AND r.bin > coalesce(l, -1) AND r.bin < coalesce(h, 1e15) GROUP BY 1, 2),
pk AS (SELECT * FROM pr WHERE prominence >= 5)"""
CLIPS = PEAKS + """, cl AS (SELECT stream_id, bin, time_seconds, greatest(0.0, time_seconds - 10800) AS s, time_seconds + 10800 AS e, value FROM pk)"""


def union_sql(src: str, out: str, gap: float = 0) -> str:
    return f"""{out}_a AS (SELECT stream_id, s, e, max(e) OVER (PARTITION BY stream_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {src}),
{out}_b AS (SELECT *, sum(CASE WHEN s - b <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {out}_a),
{out} AS (SELECT stream_id, min(s) AS s, max(e) AS e FROM {out}_b GROUP BY stream_id, g)"""


SPANS = """sp AS (SELECT l_returnflag AS stream_id, l_orderkey AS id, CAST(epoch(min(l_shipdate)) / 86400 AS DOUBLE) AS s, CAST(epoch(max(l_shipdate)) / 86400 + 1 AS DOUBLE) AS e FROM lineitem GROUP BY 1, 2),
ra AS (SELECT * FROM sp)"""


def spans(spark, d):
    day = F.col("l_shipdate").cast("timestamp").cast("double") / 86400
    return parquet(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("stream_id"), F.col("l_orderkey").alias("id")).agg(F.min(day).alias("start"), (F.max(day) + 1).alias("end"))


@query("WITH " + MSG + " SELECT stream_id, count(*) AS messages, max(seconds) AS max_seconds, count(DISTINCT author) AS authors FROM msg GROUP BY 1")
def chat_summary(spark, d):
    return R.events(spark, d).groupBy("stream_id").agg(F.count("*").alias("messages"), F.max("seconds").alias("max_seconds"), F.count_distinct("author").alias("authors"))


@query("WITH " + HIST + " SELECT stream_id, bin * 3600 AS bin_start, (bin + 1) * 3600 AS bin_end, cnt AS raw_count FROM hist")
def hist_zero_filled(spark, d):
    return hist(spark, d).select("stream_id", (F.col("bin") * STEP).alias("bin_start"), ((F.col("bin") + 1) * STEP).alias("bin_end"), F.col("cnt").alias("raw_count"))


@query("WITH " + ROLL + " SELECT stream_id, bin, time_seconds, frequency FROM roll")
def rolling_sum(spark, d):
    return roll(spark, d)


@query("WITH " + MSG + """, w AS (SELECT stream_id, unnest(range(seconds // 3600 - 5, seconds // 3600 + 1)) AS k FROM msg)
SELECT stream_id, k * 3600 AS start_seconds, count(*) AS frequency FROM w GROUP BY 1, 2""")
def rolling_via_time_window(spark, d):
    m = R.events(spark, d).withColumn("ts", F.timestamp_seconds(F.col("seconds") + R.EPOCH))
    return live.hopping_counts(m, window=f"{WINDOW} seconds", step=f"{STEP} seconds").select("stream_id", (F.col("start").cast("bigint") - R.EPOCH).alias("start_seconds"), "frequency")


@query("WITH " + ROLL + " SELECT stream_id, bin, time_seconds, frequency FROM roll WHERE time_seconds BETWEEN 86400 AND 864000")
def time_filtered_series(spark, d):
    return S.between(roll(spark, d), 86400, 864000)


@query("WITH " + MSG + ", h AS (SELECT row_id, seconds, CASE WHEN seconds >= 3600 THEN (seconds // 3600) || ':' || lpad(CAST(seconds // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(seconds // 60 AS VARCHAR) END || ':' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0') AS hms FROM msg) SELECT row_id, hms, seconds AS parsed FROM h")
def hms_roundtrip(spark, d):
    return R.events(spark, d).select("row_id", seconds_to_hms("seconds").alias("hms")).withColumn("parsed", parse_time("hms"))


def _trend(degree):
    def f(spark, d):
        return S.trend(roll(spark, d), degree).select("stream_id", "bin", F.round("trend", 4).alias("trend"))

    f.__name__ = f"trend_deg{degree}"
    return f


for _k in (1, 3):
    query("WITH " + trend_sql(_k) + " SELECT stream_id, bin, round(trend, 4) AS trend FROM tr")(_trend(_k))


@query("WITH " + NORM + " SELECT stream_id, time_seconds, CASE WHEN time_seconds >= 3600 THEN CAST(CAST(time_seconds AS BIGINT) // 3600 AS VARCHAR) || ':' || lpad(CAST(CAST(time_seconds AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') ELSE '' END || ':00' AS time_hms, frequency, round(trend, 4) AS trend, round(normalized, 4) AS normalized FROM nm")
def normalized_signal(spark, d):
    return S.with_hms(norm(spark, d)).select("stream_id", "time_seconds", "time_hms", "frequency", F.round("trend", 4).alias("trend"), F.round("normalized", 4).alias("normalized"))


@query("WITH " + MAXIMA + " SELECT stream_id, bin, value FROM mx")
def local_maxima(spark, d):
    return P.local_maxima(roll(spark, d))


def found(spark, d):
    return P.peaks(roll(spark, d), step=STEP, window=WINDOW, prominence=PROMINENCE)


@query("WITH RECURSIVE " + PEAKS + " SELECT stream_id, bin, time_seconds, value, prominence FROM pk")
def peaks(spark, d):
    return found(spark, d)


@query("WITH RECURSIVE " + PEAKS + """, nr AS (SELECT p.stream_id, p.bin, m.row_id, m.message, row_number() OVER (PARTITION BY p.stream_id, p.bin ORDER BY m.row_id) AS r
  FROM pk p JOIN msg m ON m.stream_id = p.stream_id AND abs(m.seconds - p.time_seconds) <= 7200)
SELECT p.stream_id, p.time_seconds AS peak_time_seconds, p.value AS peak_frequency, coalesce(string_agg(substr(n.message, 1, 50), '; ' ORDER BY n.row_id), '') AS sample_messages
FROM pk p LEFT JOIN nr n ON n.stream_id = p.stream_id AND n.bin = p.bin AND n.r <= 3 GROUP BY 1, 2, 3""")
def peak_sample_messages(spark, d):
    p = I.sample_messages(found(spark, d).withColumn("id", F.col("bin")), R.events(spark, d), margin=MARGIN)
    return p.select("stream_id", F.col("time_seconds").alias("peak_time_seconds"), F.col("value").alias("peak_frequency"), "sample_messages")


@query("WITH " + MAXIMA + """, nr AS (SELECT p.stream_id, p.bin AS id, m.row_id, m.seconds, m.message, row_number() OVER (PARTITION BY p.stream_id, p.bin ORDER BY m.row_id) AS r
  FROM mx p JOIN msg m ON m.stream_id = p.stream_id AND abs(m.seconds - (p.bin * 3600 + 10800.0)) <= 7200)
SELECT stream_id, id, r, seconds, CASE WHEN length(message) > 12 THEN substr(message, 1, 12) || '...' ELSE message END AS preview FROM nr WHERE r <= 5""")
def nearest_messages_topk(spark, d):
    p = P.local_maxima(roll(spark, d)).select("stream_id", F.col("bin").alias("id"), (F.col("bin") * STEP + WINDOW / 2).alias("time_seconds"))
    return I.messages_near(p, R.events(spark, d), margin=MARGIN).select("stream_id", "id", "r", "seconds", I.preview(F.col("message"), 12).alias("preview"))


def peak_clips(spark, d):
    return I.clips(found(spark, d), PAD, PAD)


@query("WITH RECURSIVE " + CLIPS + " SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY s) AS clip_index, s AS start_seconds, time_seconds AS peak_seconds, e AS end_seconds, value AS peak_frequency FROM cl")
def clip_timestamps(spark, d):
    c = peak_clips(spark, d)
    return c.select("stream_id", F.row_number().over(Window.partitionBy("stream_id").orderBy("start")).cast("long").alias("clip_index"), F.col("start").alias("start_seconds"), F.col("time_seconds").alias("peak_seconds"), F.col("end").alias("end_seconds"), F.col("value").alias("peak_frequency"))


@query("WITH RECURSIVE " + CLIPS + ", " + union_sql("cl", "un") + " SELECT u.stream_id, u.s AS start_time_seconds, u.e AS end_time_seconds, min(time_seconds) AS peak_time_seconds FROM un u JOIN cl c ON c.stream_id = u.stream_id AND c.time_seconds BETWEEN u.s AND u.e GROUP BY 1, 2, 3")
def merged_clips(spark, d):
    c = peak_clips(spark, d)
    u = I.union(c).withColumn("start2", F.col("start")).withColumn("end2", F.col("end")).drop("start", "end")
    p = c.select("stream_id", "time_seconds", F.col("time_seconds").alias("start"), (F.col("time_seconds") + 1e-6).alias("end"))
    return I.range_join(p, u, 86400.0).groupBy("stream_id", F.col("start2").alias("start_time_seconds"), F.col("end2").alias("end_time_seconds")).agg(F.min("time_seconds").alias("peak_time_seconds"))


@query("WITH RECURSIVE " + CLIPS + ", " + union_sql("cl", "un") + """, nm AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY s) - 1 AS i, printf('%.3f', s) AS a, printf('%.3f', e) AS b FROM un)
SELECT stream_id, 'ffmpeg -i "in.mp4" -filter_complex "' || string_agg('[0:v]trim=start=' || a || ':end=' || b || ',setpts=PTS-STARTPTS[v' || i || '];[0:a]atrim=start=' || a || ':end=' || b || ',asetpts=PTS-STARTPTS[a' || i || '];', '' ORDER BY i)
 || string_agg('[v' || i || '][a' || i || ']', '' ORDER BY i) || 'concat=n=' || count(*) || ':v=1:a=1[v][a]" -map "[v]" -map "[a]" "reel.mp4"' AS script FROM nm GROUP BY 1""")
def reel_script(spark, d):
    return I.reel_script(I.union(peak_clips(spark, d)), "in.mp4")


@query("WITH " + ROLL + """, x AS (SELECT stream_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY stream_id) AS n, sum(frequency) OVER w AS s, sum(frequency * frequency) OVER w AS q,
 sum(frequency) OVER (PARTITION BY stream_id) AS ss, sum(frequency * frequency) OVER (PARTITION BY stream_id) AS qq FROM roll WINDOW w AS (PARTITION BY stream_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, s / k AS m1, (ss - s) / (n - k) AS m2 FROM x WHERE k >= 5 AND k < n - 5),
z AS (SELECT *, (k * (q / k - m1 * m1) + (n - k) * ((qq - q) / (n - k) - m2 * m2)) / (n - 2) AS p FROM y),
t AS (SELECT stream_id, k, abs(m1 - m2) / sqrt(p * (1.0 / k + 1.0 / (n - k))) AS t FROM z WHERE p > 1e-12)
SELECT stream_id, k, t FROM (SELECT stream_id, k, round(t, 6) AS t, row_number() OVER (PARTITION BY stream_id ORDER BY round(t, 9) DESC, k) AS r FROM t) WHERE r = 1""")
def best_split(spark, d):
    return G.best_split(roll(spark, d)).select("stream_id", F.col("k").cast("long").alias("k"), F.round("t", 6).alias("t"))


def segment_sql(src: str, value: str, min_seg: int, least: int = 1) -> str:
    """Binary segmentation as a recursion: leaves of lf are the segments [a, b) of positions in the series."""
    return f"""ix AS (SELECT * FROM (SELECT stream_id, time_seconds, {value} AS v, row_number() OVER (PARTITION BY stream_id ORDER BY bin) AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM {src}) WHERE n >= {least}),
px AS (SELECT stream_id, i, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM ix WINDOW w AS (PARTITION BY stream_id ORDER BY i ROWS UNBOUNDED PRECEDING) UNION ALL SELECT DISTINCT stream_id, 0, 0.0, 0.0 FROM ix),
sg(stream_id, a, b) AS (SELECT stream_id, CAST(0 AS BIGINT), max(i) FROM ix GROUP BY 1 UNION ALL
  SELECT stream_id, unnest([a, a + k]), unnest([a + k, b]) FROM (SELECT stream_id, a, b, list(k ORDER BY t DESC, k)[1] AS k, max(t) AS t FROM (
    SELECT *, abs(m1 - m2) / sqrt(p * (1.0 / k + 1.0 / r)) AS t FROM (SELECT *, (k * (q1 / k - m1 * m1) + r * (q2 / r - m2 * m2)) / (k + r - 2) AS p FROM (
      SELECT g.stream_id, g.a, g.b, m.i - g.a AS k, g.b - m.i AS r, m.q - lo.q AS q1, hi.q - m.q AS q2, (m.s - lo.s) / (m.i - g.a) AS m1, (hi.s - m.s) / (g.b - m.i) AS m2
      FROM sg g JOIN px m ON m.stream_id = g.stream_id AND m.i >= g.a + {min_seg} AND m.i < g.b - {min_seg} JOIN px lo ON lo.stream_id = g.stream_id AND lo.i = g.a JOIN px hi ON hi.stream_id = g.stream_id AND hi.i = g.b)) WHERE p > 1e-12)
  GROUP BY 1, 2, 3) WHERE t > 2.5),
lf AS (SELECT x.* FROM sg x WHERE NOT EXISTS (SELECT 1 FROM sg y WHERE y.stream_id = x.stream_id AND y.a = x.a AND y.b < x.b))"""


def regions_sql(src: str, value: str) -> str:
    return segment_sql(src, value, 3, 20) + """, st AS (SELECT stream_id, avg(v) AS m, stddev_pop(v) AS sd FROM ix GROUP BY 1),
sx AS (SELECT l.stream_id, l.a, avg(v) AS v, min(time_seconds) AS t0, max(time_seconds) AS t1 FROM lf l JOIN ix ON ix.stream_id = l.stream_id AND i > a AND i <= b GROUP BY 1, 2),
iv AS (SELECT stream_id, greatest(0.0, t0 - 1800) AS s, t1 + 1800 AS e FROM sx JOIN st USING (stream_id) WHERE sd > 0 AND v >= m), """ + union_sql("iv", "un", 10800) + """,
rs AS (SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY s) AS INTEGER) AS region_index, s AS start_seconds, e AS end_seconds FROM un WHERE e - s >= 10800)"""


def hms_sql(c: str) -> str:
    c = f"CAST({c} AS BIGINT)"
    return f"CASE WHEN {c} >= 3600 THEN ({c} // 3600) || ':' || lpad(CAST({c} // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST({c} // 60 AS VARCHAR) END || ':' || lpad(CAST({c} % 60 AS VARCHAR), 2, '0')"


@query("WITH RECURSIVE " + ROLL + ", " + segment_sql("roll", "frequency", 5) + " SELECT stream_id, a AS seg_start, b AS seg_end FROM lf")
def cbs_segments(spark, d):
    return G.segments(roll(spark, d))


def found_regions(spark, d, z=0.0):
    return G.regions(norm(spark, d), value="normalized", step=STEP, min_duration=PAD, max_gap=PAD, z=z)


@query("WITH RECURSIVE " + ROLL + ", " + regions_sql("roll", "frequency") + " SELECT * FROM rs")
def high_regions(spark, d):
    return G.regions(roll(spark, d), step=STEP, min_duration=PAD, max_gap=PAD)


@query("WITH RECURSIVE " + NORM + ", " + regions_sql("nm", "normalized") + f" SELECT *, {hms_sql('start_seconds')} AS start_hms, {hms_sql('end_seconds')} AS end_hms, end_seconds - start_seconds AS duration_seconds FROM rs")
def regions_normalized(spark, d):
    return S.with_hms(found_regions(spark, d), "start_seconds", "end_seconds").withColumn("duration_seconds", F.col("end_seconds") - F.col("start_seconds"))


@query("WITH " + ROLL + """, ix AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY bin) - 1 AS i FROM roll), st AS (SELECT stream_id, avg(frequency) AS m, stddev_pop(frequency) AS sd FROM roll GROUP BY 1),
sg AS (SELECT stream_id, i // 12 AS g, avg(frequency) AS v, min(i) AS lo, max(i) AS hi, min(time_seconds) AS t0, max(time_seconds) AS t1 FROM ix GROUP BY 1, 2),
hs AS (SELECT sg.* FROM sg JOIN st USING (stream_id) WHERE sd > 0 AND v >= m),
iv AS (SELECT stream_id, greatest(0.0, t0 - 1800) AS s, t1 + 1800 AS e FROM hs), """ + union_sql("iv", "un", 10800) + " SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY s) AS region_index, s AS start_seconds, e AS end_seconds FROM un WHERE e - s >= 10800")
def classify_merge(spark, d):
    r = roll(spark, d)
    n = r.groupBy("stream_id").agg(F.count("*").alias("n"))
    segs = n.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(12).cast("long"))).alias("seg_start"))
    return G.classify(r, segs, step=STEP, min_duration=PAD, max_gap=PAD).withColumn("region_index", F.col("region_index").cast("long"))


@query("WITH " + SPANS + ", " + union_sql("ra", "un") + ' SELECT stream_id, s AS "start", e AS "end" FROM un')
def interval_union(spark, d):
    return I.union(spans(spark, d))


@query("WITH " + SPANS + ", rb AS (SELECT * FROM sp) SELECT a.stream_id, a.id, coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)) FILTER (WHERE b.s IS NOT NULL), 0.0) AS covered FROM rb a LEFT JOIN ra b ON a.stream_id = b.stream_id AND b.s < a.e AND b.e > a.s GROUP BY 1, 2")
def overlap_seconds(spark, d):
    s = spans(spark, d)
    return I.overlap_sums(s, s, 120.0).select("stream_id", "id", "covered")


@query("WITH RECURSIVE " + CLIPS + " SELECT r.stream_id, r.bin, CAST(max(CASE WHEN c.s IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS flag FROM roll r LEFT JOIN cl c ON c.stream_id = r.stream_id AND c.s < r.time_seconds + 1800 AND c.e > r.time_seconds - 1800 GROUP BY 1, 2")
def bin_clipped_flags(spark, d):
    return I.flags(roll(spark, d).withColumn("id", F.col("bin")), peak_clips(spark, d), STEP / 2, 86400.0).select("stream_id", "bin", "flag")


def two_sides(spark, d):
    """Regions of a fixed grid of half days, and the peak clips that are to cover them."""
    ends = roll(spark, d).groupBy("stream_id").agg(F.max("time_seconds").alias("t"))
    r = ends.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("t") / 86400))).alias("id"))
    return r.select("stream_id", "id", (F.col("id") * 86400.0).alias("start"), (F.col("id") * 86400.0 + 43200).alias("end")), peak_clips(spark, d)


SIDES = CLIPS + ", " + union_sql("cl", "un") + ", rg AS (SELECT stream_id, unnest(range(CAST(floor(max(time_seconds) / 86400) AS BIGINT) + 1)) AS id FROM roll GROUP BY 1), rv AS (SELECT stream_id, id, id * 86400.0 AS s, id * 86400.0 + 43200 AS e FROM rg), cv AS (SELECT r.stream_id, r.id, any_value(r.e - r.s) AS len, coalesce(sum(least(r.e, u.e) - greatest(r.s, u.s)) FILTER (WHERE u.s IS NOT NULL), 0.0) AS covered FROM rv r LEFT JOIN un u ON u.stream_id = r.stream_id AND u.s < r.e AND u.e > r.s GROUP BY 1, 2)"


@query("WITH RECURSIVE " + SIDES + """, en AS (SELECT r.stream_id, r.id, round(avg(frequency), 4) AS mean_engagement, round(max(frequency), 4) AS max_engagement FROM rv r JOIN roll x ON x.stream_id = r.stream_id AND x.time_seconds BETWEEN r.s AND r.e GROUP BY 1, 2)
SELECT c.stream_id, c.id, covered, round(covered / len, 4) AS coverage_frac, CAST(covered > 0 AS INTEGER) AS covered_at_0pct, CAST(covered / len >= 0.25 AS INTEGER) AS covered_at_25pct, CAST(covered / len >= 0.5 AS INTEGER) AS covered_at_50pct, CAST(covered / len >= 0.75 AS INTEGER) AS covered_at_75pct, mean_engagement, max_engagement FROM cv c LEFT JOIN en USING (stream_id, id)""")
def region_coverage(spark, d):
    r, c = two_sides(spark, d)
    return O.coverage(r, c, roll(spark, d), "frequency", 86400.0).drop("start", "end")


@query("WITH RECURSIVE " + SIDES + ", ct AS (SELECT stream_id, sum(e - s) AS clipped_seconds FROM un GROUP BY 1) SELECT stream_id, sum(len) AS region_seconds, sum(covered) AS both_seconds, any_value(clipped_seconds) AS clipped_seconds, round(sum(covered) / sum(len), 4) AS recall, round(sum(covered) / any_value(clipped_seconds), 4) AS precision FROM cv LEFT JOIN ct USING (stream_id) GROUP BY 1")
def recall_precision(spark, d):
    return O.recall_precision(*two_sides(spark, d), 86400.0)


@query("SELECT n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM (SELECT count(*) AS n, corr(quality, n_chars) AS r FROM labels JOIN documents USING (doc_id))")
def pointbiserial(spark, d):
    j = parquet(spark, d, "labels").select("doc_id", "quality").join(parquet(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return O.pointbiserial(j, "quality", "n_chars").select("n", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"))


@query("WITH RECURSIVE " + CLIPS + NORM[len(ROLL):] + """, fl AS (SELECT r.stream_id, r.bin, any_value(r.normalized) AS v, max(CASE WHEN c.s IS NOT NULL THEN 1 ELSE 0 END) AS flag FROM nm r LEFT JOIN cl c ON c.stream_id = r.stream_id AND c.s < r.time_seconds + 1800 AND c.e > r.time_seconds - 1800 GROUP BY 1, 2),
co AS (SELECT stream_id, count(*) AS n, sum(flag) AS ones, corr(flag, v) AS r0 FROM fl GROUP BY 1),
rt AS (SELECT stream_id, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT stream_id, n, CASE WHEN n > 10 AND ones > 5 AND n - ones > 5 THEN r0 END AS r FROM co)),
si AS (SELECT stream_id, i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(n - 1) / 2.0 * ln(1 + power(i * abs(t) / 2000, 2) / (n - 2))) AS y FROM rt, range(2001) x(i)),
ar AS (SELECT stream_id, sum(y) AS y FROM si GROUP BY 1)
SELECT stream_id, n, round(r, 6) AS r, round(t, 4) AS t, round(greatest(0.0, 1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi() * (n - 2)) * abs(t) / 6000 * y), 6) AS p FROM rt JOIN ar USING (stream_id)""")
def pointbiserial_p(spark, d):
    f = I.flags(norm(spark, d).withColumn("id", F.col("bin")), peak_clips(spark, d), STEP / 2, 86400.0)
    p = O.pointbiserial(f, "flag", "normalized", ["stream_id"])
    return p.select("stream_id", "n", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"), F.round("p", 6).alias("p"))


METRICS = ["messages", "max_seconds", "authors"]


@query("WITH " + MSG + ", a AS (SELECT stream_id, count(*) AS messages, max(seconds) AS max_seconds, count(DISTINCT author) AS authors FROM msg GROUP BY 1) " + " UNION ALL ".join(f"SELECT stream_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM a" for m in METRICS))
def metrics_long(spark, d):
    return O.metrics_long(chat_summary(spark, d), METRICS)


@query("WITH " + MSG + " SELECT stream_id, CAST(count(*) AS DOUBLE) AS messages, CAST(max(seconds) AS DOUBLE) AS max_seconds, CAST(count(DISTINCT author) AS DOUBLE) AS authors FROM msg GROUP BY 1")
def metrics_wide(spark, d):
    return O.metrics_wide(metrics_long(spark, d), METRICS)


@query("""WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS v, quality FROM labels JOIN documents USING (doc_id)), e AS (SELECT list_distinct([""" + ", ".join(f"quantile_cont(v, {k / 15})" for k in range(16)) + """]) AS e FROM x),
b AS (SELECT v, quality, least(greatest(len(list_filter(e, lambda q: q <= v)) - 1, 0), len(e) - 2) AS bucket FROM x, e)
SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(v), 4) AS mean_value, round(avg(quality), 4) AS share, count(*) AS n FROM b GROUP BY 1""")
def quantile_buckets(spark, d):
    j = parquet(spark, d, "labels").select("doc_id", "quality").join(parquet(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("v")), "doc_id")
    return O.quantile_buckets(j, "v", "quality").select("bucket", F.round("mean_value", 4).alias("mean_value"), F.round("share", 4).alias("share"), "n")


@query("WITH RECURSIVE " + SIDES + " SELECT CAST(least(floor(round(covered / len, 4) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM cv GROUP BY 1")
def coverage_hist(spark, d):
    return O.unit_histogram(O.coverage(*two_sides(spark, d), width=86400.0), "coverage_frac")


RMS = """rm AS (SELECT event_type AS stream_id, (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 3600 AS frame, sqrt(avg(value * value)) AS rms FROM events GROUP BY 1, 2),
rf AS (SELECT stream_id, quantile_cont(rms, 0.95) AS ref FROM rm GROUP BY 1), db AS (SELECT stream_id, frame, 20 * log10(greatest(rms / ref, 1e-10)) AS db FROM rm JOIN rf USING (stream_id))"""


def rms(spark, d):
    return R.events(spark, d).groupBy("stream_id", F.floor(F.col("seconds") / STEP).alias("frame")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


@query("WITH " + RMS + " SELECT stream_id, frame, round(db, 4) AS db FROM db")
def loudness_db(spark, d):
    return V.loudness(rms(spark, d)).select("stream_id", "frame", F.round("db", 4).alias("db"))


@query("WITH " + RMS + ', q AS (SELECT stream_id, frame, frame - row_number() OVER (PARTITION BY stream_id ORDER BY frame) AS g FROM db WHERE db < -6) SELECT stream_id, CAST(min(frame) * 3600.0 AS DOUBLE) AS "start", CAST((max(frame) + 1) * 3600.0 AS DOUBLE) AS "end" FROM q GROUP BY stream_id, g HAVING count(*) >= 2')
def silence_runs(spark, d):
    return V.silences(rms(spark, d), threshold_db=-6.0, hop=3600.0, min_frames=2)


CUES = """cu AS (SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn, CAST(turn * 10 AS DOUBLE) AS s, CAST(turn * 10 + 10 AS DOUBLE) AS e, trim(regexp_replace(text, '[ \t\n\r\f\\x0B]+', ' ', 'g')) AS text FROM conversations),
pv AS (SELECT *, lag(text) OVER (PARTITION BY stream_id ORDER BY s, e) AS p, max(e) OVER (PARTITION BY stream_id) AS last FROM cu WHERE text <> ''),
nw AS (SELECT *, CASE WHEN p IS NULL THEN text WHEN text = p THEN '' WHEN starts_with(text, p) THEN trim(substr(text, length(p) + 1)) ELSE text END AS new FROM pv),
ch AS (SELECT stream_id, s, coalesce(lead(s) OVER (PARTITION BY stream_id ORDER BY s, e), last) AS e, new AS text FROM nw WHERE new <> '')"""


def cues(spark, d):
    return parquet(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10).alias("end"), "text")


@query("WITH " + CUES + ' SELECT stream_id, s AS "start", e AS "end", text FROM ch')
def caption_chunks(spark, d):
    return T.chunks(cues(spark, d))


@query("WITH " + CUES + " SELECT stream_id, s AS \"start\", CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY stream_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, length(text) AS n FROM ch")
def char_offsets(spark, d):
    return T.offsets(T.chunks(cues(spark, d))).select("stream_id", "start", "char_start", (F.col("char_end") - F.col("char_start")).alias("n"))


SENTENCES = CUES + r""", mk AS (SELECT stream_id, s, e, regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\b([A-Z]\.)' || chr(1), '\1 ', 'g') AS x FROM ch),
pt AS (SELECT stream_id, s, e, list_filter(string_split(x, chr(1)), lambda y: y <> '') AS parts FROM mk),
se AS (SELECT stream_id, s, e, len(parts) AS n, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM pt)"""


@query("WITH " + SENTENCES + ' SELECT stream_id, s + i * ((e - s) / n) AS "start", s + (i + 1) * ((e - s) / n) AS "end", part AS text FROM se')
def sentence_split(spark, d):
    return T.split_sentences(T.chunks(cues(spark, d)))


@query("WITH " + SENTENCES + r""", en AS (SELECT *, coalesce(sum(CAST(regexp_matches(part, '[.!?]["'')\]]*$') AS INTEGER)) OVER (PARTITION BY stream_id ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM se),
gs AS (SELECT stream_id, g, min(s) AS s, max(e) AS e, string_agg(part, ' ' ORDER BY s, e, i) AS text FROM en GROUP BY 1, 2),
nr AS (SELECT *, abs(s - lag(s) OVER w) < 0.01 AND abs(e - lag(e) OVER w) < 0.01 AS near FROM gs WINDOW w AS (PARTITION BY stream_id ORDER BY s, e, g))
SELECT stream_id, s AS "start", e AS "end", text FROM nr WHERE NOT coalesce(near, false)""")
def sentence_intervals(spark, d):
    return T.sentences(T.chunks(cues(spark, d)))


@query("WITH " + CUES + ", pt AS (SELECT stream_id, s + 3.0 AS t, row_number() OVER (PARTITION BY stream_id ORDER BY s) AS id FROM ch), nr AS (SELECT p.stream_id, p.id, c.s, row_number() OVER (PARTITION BY p.stream_id, p.id ORDER BY abs(c.s - p.t), c.s) AS r FROM pt p JOIN ch c ON c.stream_id = p.stream_id AND abs(c.s - p.t) <= 8) SELECT p.stream_id, p.id, n.s AS near FROM pt p LEFT JOIN nr n ON n.stream_id = p.stream_id AND n.id = p.id AND n.r = 1")
def nearest_sentence_start(spark, d):
    c = T.chunks(cues(spark, d))
    order = F.row_number().over(Window.partitionBy("stream_id").orderBy("start")).cast("long")
    points = c.select("stream_id", order.alias("id"), (F.col("start") + 3).alias("time_seconds"))
    return I.nearest(points, c.select("stream_id", F.col("start").alias("at"), order.alias("order")), 8.0, "near").select("stream_id", "id", "near")


@query("WITH " + CUES + """, od AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY s, e) AS o FROM ch),
ro AS (SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY s) AS INTEGER) AS id, s + 2 AS s, e + 1.5 AS e FROM ch),
ns AS (SELECT r.stream_id, r.id, list(k.s ORDER BY abs(k.s - r.s), k.o)[1] AS x FROM ro r JOIN od k ON k.stream_id = r.stream_id AND abs(k.s - r.s) <= 3 GROUP BY 1, 2),
ne AS (SELECT r.stream_id, r.id, list(k.e ORDER BY abs(k.e - r.e), k.o)[1] AS x FROM ro r JOIN od k ON k.stream_id = r.stream_id AND abs(k.e - r.e) <= 3 GROUP BY 1, 2),
mv AS (SELECT r.*, coalesce(a.x, r.s) AS a, coalesce(b.x, r.e) AS b FROM ro r LEFT JOIN ns a USING (stream_id, id) LEFT JOIN ne b USING (stream_id, id))
SELECT stream_id, id, CASE WHEN b - a >= 0.5 THEN a ELSE s END AS "start", CASE WHEN b - a >= 0.5 THEN b ELSE e END AS "end" FROM mv""")
def snap_clips(spark, d):
    c = T.chunks(cues(spark, d))
    rough = c.select("stream_id", F.row_number().over(Window.partitionBy("stream_id").orderBy("start")).alias("id"), (F.col("start") + 2).alias("start"), (F.col("end") + 1.5).alias("end"))
    return I.snap(rough, c)


TOK = "list_filter(list_transform(regexp_split_to_array(lower({0}), '[ \t\n\r\f\\x0B]+'), lambda w: regexp_replace(w, '[^a-z0-9'']', '', 'g')), lambda w: length(w) > 1)"


@query("WITH t AS (SELECT item_id, " + TOK.format("text") + " AS w FROM benchmark) SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS ngram FROM t WHERE len(w) >= 3")
def tokens_ngrams(spark, d):
    return parquet(spark, d, "benchmark").select("item_id", F.explode(T.ngrams(T.tokens(F.col("text")))).alias("ngram"))


VOTE = "WITH b AS (SELECT item_id, " + TOK.format("text") + " AS w FROM benchmark), d AS (SELECT doc_id, " + TOK.format("text") + " AS w FROM documents), bg AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM b WHERE len(w) >= 3), dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3), tt AS (SELECT item_id, count(*) AS total FROM bg GROUP BY 1), v AS (SELECT item_id, doc_id, count(*) AS votes FROM bg JOIN dg USING (g) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, doc_id) AS r FROM v) SELECT item_id, doc_id, votes, total, round(votes / total, 6) AS confidence FROM r JOIN tt USING (item_id) WHERE r = 1"


@query(VOTE)
def ngram_vote(spark, d):
    """The document that shares most three-grams with each benchmark item, as one stream of chunks 10 seconds apart."""
    g = tokens_ngrams(spark, d).select(F.col("item_id").alias("window_id"), "ngram")
    docs = parquet(spark, d, "documents").select(F.lit("all").alias("stream_id"), F.explode(T.ngrams(T.tokens(F.col("text")))).alias("ngram"), (F.col("doc_id") * 10.0).alias("chunk_start"), F.col("doc_id").alias("chunk_idx"))
    v = T.vote(g, docs)
    return v.select(F.col("window_id").alias("item_id"), F.col("bin").alias("doc_id"), "votes", "total", F.round("confidence", 6).alias("confidence"))


GRAMS = "unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g"
SPEECH = "NOT regexp_matches(trim(text), '(?s)^\\[.*\\]$') AND NOT regexp_matches(trim(text), '(?s)^♪.*♪$') AND len(w) >= 3"


def clusters_sql(src: str, shift: float, gap: float, least: int, cover: float = 0) -> str:
    return f"""cb AS (SELECT *, CASE WHEN abs(o - lag(o) OVER w) > {shift} OR s - lag(e) OVER w > {gap} THEN 1 ELSE 0 END AS new FROM {src} WINDOW w AS (PARTITION BY stream_id ORDER BY s, e)),
cg AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY s, e) AS g FROM cb)
SELECT stream_id, count(*) AS n, min(s) AS "start", max(e) AS "end", quantile_cont(o, 0.5) AS "offset" FROM cg GROUP BY stream_id, g HAVING count(*) >= {least} AND max(e) - min(s) >= {cover}"""


@query("WITH " + CUES + ", cx AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY s) AS idx, " + TOK.format("text") + " AS w FROM ch), ci AS (SELECT stream_id, s, idx, " + GRAMS + " FROM cx WHERE " + SPEECH + """),
du AS (SELECT stream_id, max(e) AS dur FROM ch GROUP BY 1), wi AS (SELECT stream_id, k * 5.0 AS t, least(k * 5.0 + 30, dur) AS z FROM (SELECT *, unnest(range(greatest(1, CAST(ceil((dur - 15) / 5) AS BIGINT)))) AS k FROM du)),
wt AS (SELECT i.stream_id, t, string_agg(text, ' ' ORDER BY s, e, text) AS text FROM wi i JOIN ch c ON c.stream_id = i.stream_id AND c.e > t AND c.s < z GROUP BY 1, 2),
wx AS (SELECT *, """ + TOK.format("text") + " AS w FROM wt), wg AS (SELECT stream_id, t, " + GRAMS + " FROM wx WHERE " + SPEECH + """),
tt AS (SELECT stream_id, t, count(*) AS total FROM wg GROUP BY 1, 2), hi AS (SELECT w.stream_id, w.t, c.s, c.idx, floor(c.s / 10) AS bin FROM wg w JOIN ci c USING (stream_id, g)),
bi AS (SELECT stream_id, t, bin, count(*) AS votes, row_number() OVER (PARTITION BY stream_id, t ORDER BY count(*) DESC, bin) AS r FROM hi GROUP BY 1, 2, 3),
nc AS (SELECT h.stream_id, h.t, h.s, b.votes, row_number() OVER (PARTITION BY h.stream_id, h.t ORDER BY count(*) DESC, h.idx) AS r FROM hi h JOIN bi b ON b.stream_id = h.stream_id AND b.t = h.t AND b.r = 1 AND h.s BETWEEN b.bin * 10 - 5 AND (b.bin + 1.5) * 10 GROUP BY h.stream_id, h.t, h.s, h.idx, b.votes),
ma AS (SELECT stream_id, CAST(t AS DOUBLE) AS s, CAST(t + 30 AS DOUBLE) AS e, CAST(s - t AS DOUBLE) AS o FROM nc JOIN tt USING (stream_id, t) WHERE r = 1 AND votes / total >= 0.05), """ + clusters_sql("ma", 45, 30, 2))
def text_alignment(spark, d):
    """Sliding windows of each conversation voted against all chunks, then clustered by offset."""
    v = T.align(T.chunks(cues(spark, d))).where(F.col("confidence") >= 0.05)
    m = v.select("stream_id", F.col("t").alias("start"), (F.col("t") + 30).alias("end"), (F.col("chunk_start") - F.col("t")).alias("offset"))
    return T.offset_clusters(m, max_shift=45, max_gap=30, least=2)


def z(spark, d):
    return parquet(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), V.zscore(F.col("embedding")).alias("z"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT *, list_avg(v) AS a, list_stddev_pop(v) AS sd FROM e) SELECT vec_id AS frame, round((v[1] - a) / (sd + 1e-8), 4) AS first_value, round((v[64] - a) / (sd + 1e-8), 4) AS last_value FROM m")
def frame_zscore(spark, d):
    return z(spark, d).select("frame", F.round(F.get("z", F.lit(0)), 4).alias("first_value"), F.round(F.get("z", F.lit(63)), 4).alias("last_value"))


NCC = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT *, list_avg(v) AS a, list_stddev_pop(v) AS sd FROM e), z AS (SELECT vec_id AS frame, list_transform(v, lambda x: (x - a) / (sd + 1e-8)) AS z FROM m), s AS (SELECT a.frame AS r, b.frame AS k, list_inner_product(a.z, b.z) / 64 AS s FROM z a, z b), n AS (SELECT r, k, avg(s) OVER w AS ncc, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY k - r ORDER BY r ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)), f AS (SELECT * FROM n WHERE n = 10) "


def best_lags(spark, d):
    e = z(spark, d)
    return V.ncc_best_lag(e, e, 10)


@query(NCC + "SELECT r, k, round(ncc, 4) AS ncc FROM f")
def ncc_diagonal(spark, d):
    e = z(spark, d)
    return V.ncc(e, e, 10, digits=4)


@query(NCC + "SELECT r, k, ncc FROM (SELECT r, k, round(ncc, 4) AS ncc, row_number() OVER (PARTITION BY r ORDER BY round(ncc, 9) DESC, k) AS x FROM f) WHERE x = 1 AND ncc >= 0.3")
def ncc_best_lag(spark, d):
    return best_lags(spark, d).select("r", "k", F.round("ncc", 4).alias("ncc"))


@query(NCC + ", bl AS (SELECT 'clip' AS stream_id, CAST(r AS DOUBLE) AS s, r + 10.0 AS e, CAST(k - r AS DOUBLE) AS o FROM (SELECT r, k, ncc, row_number() OVER (PARTITION BY r ORDER BY round(ncc, 9) DESC, k) AS x FROM f) WHERE x = 1 AND ncc >= 0.3), " + clusters_sql("bl", 6, 6, 3, 8))
def ncc_clusters(spark, d):
    m = best_lags(spark, d).select(F.lit("clip").alias("stream_id"), F.col("r").cast("double").alias("start"), (F.col("r") + 10.0).alias("end"), (F.col("k") - F.col("r")).cast("double").alias("offset"))
    return T.offset_clusters(m, max_shift=6, max_gap=6, least=3, least_cover=8)


@query("WITH " + HIST + ", x AS (SELECT stream_id, bin, corr(cnt, bin) OVER w AS r, count(*) OVER w AS k FROM hist WINDOW w AS (PARTITION BY stream_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) SELECT stream_id, bin, round(CASE WHEN isfinite(r) THEN r END, 4) AS r FROM x WHERE k = 24")
def window_pearson(spark, d):
    """Correlation of each day-long window with a rising ramp."""
    w = Window.partitionBy("stream_id").orderBy("bin").rowsBetween(0, 23)
    x = hist(spark, d).select("stream_id", "bin", corr(F.col("cnt").cast("double"), F.col("bin").cast("double"), w).alias("r"), F.count("*").over(w).alias("k")).where("k = 24")
    return x.select("stream_id", "bin", F.round("r", 4).alias("r"))


@query("WITH " + MSG + """, g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w < 1800 THEN 0 ELSE 1 END AS new FROM (SELECT event_type AS stream_id, event_id, ts FROM events) WINDOW w AS (PARTITION BY stream_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT stream_id, round(epoch(min(ts)), 3) AS start_seconds, round(epoch(max(ts)) + 1800, 3) AS end_seconds, count(*) AS messages FROM s GROUP BY stream_id, k""")
def live_bursts(spark, d):
    e = parquet(spark, d, "events").select(F.col("event_type").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"))
    seconds = lambda c: F.round(F.col(c).cast("double"), 3).alias(f"{c}_seconds")
    return live.bursts(e, gap="30 minutes").select("stream_id", seconds("start"), seconds("end"), "messages")


def queries():
    from . import exports  # noqa: F401  adds its own

    return dict(_q)


def oracle_sql():
    queries()
    return dict(_sql)
