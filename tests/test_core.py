import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpulse.functions.timefmt import parse_time, seconds_to_hms, srt_time
from sparkpulse.operators import intervals as I
from sparkpulse.operators import peaks as P
from sparkpulse.operators import segments as G
from sparkpulse.operators import series as S
from sparkpulse.operators import text as T
from sparkpulse.operators import vectors as V
from sparkpulse.sources import readers as R


def messages(spark, streams):
    rows = [(k, i, "a", "m", s) for k, secs in streams.items() for i, s in enumerate(secs)]
    return spark.createDataFrame(rows, "stream_id string, row_id long, author string, message string, seconds long")


def test_times(spark):
    cases = {"5:30": 330, "1:02:03": 3723, " 12.7 ": 12, "90": 90, "1:90": 150, "a:b": None, "1:2:3:4": None, "": None, "-0:05": 5, "-1:05": -55}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", parse_time("t").alias("s")).collect()} == cases
    df = spark.createDataFrame([(59.0, "0:59"), (330.9, "5:30"), (3723.0, "1:02:03"), (36000.0, "10:00:00")], "s double, t string")
    assert all(r.x == r.t for r in df.withColumn("x", seconds_to_hms("s")).collect())
    assert spark.sql("select '00:01:02,500' t").select(srt_time("t")).first()[0] == 62.5


def test_histogram_and_sliding(spark):
    m = messages(spark, {"edge": [0, 5, 10, 20], "gap": [1, 35], "zero": [0], "negative": [-3, 4]})
    h = {}
    for r in S.histogram(m, 10).orderBy("stream_id", "bin").collect():
        h.setdefault(r.stream_id, []).append(r.cnt)
    assert h == {"edge": [2, 2], "gap": [1, 0, 0, 1], "negative": [1]}
    hist = spark.createDataFrame([("a", i, c) for i, c in enumerate([1, 2, 3, 4])], "stream_id string, bin long, cnt long")
    assert [(r.time_seconds, r.frequency) for r in S.sliding(hist, 10, 20).orderBy("bin").collect()] == [(10, 3), (20, 5), (30, 7)]
    assert S.window_bins(10, 25) == 2 and S.window_bins(10, 15) == 2
    with pytest.raises(ValueError):
        S.window_bins(10, 5)
    with pytest.raises(ValueError):
        S.histogram(m, 0)


def test_trend_equals_polyfit(spark):
    y = np.random.default_rng(1).random(60) * 10
    d = spark.createDataFrame([("a", i, float(i), float(v)) for i, v in enumerate(y)] + [("b", 0, 0.0, 5.0)], "stream_id string, bin long, time_seconds double, frequency double")
    got = {(r.stream_id, r.bin): r.trend for r in S.trend(d, 3).collect()}
    fit = np.polyval(np.polyfit(np.arange(60), y, 3), np.arange(60))
    assert np.allclose([got["a", i] for i in range(60)], fit) and got["b", 0] == 0
    assert all(r.normalized == r.frequency for r in S.normalized(d, 0).collect())


def test_peaks(spark):
    x = np.array([0, 2, 0, 5, 5, 0, 1, 0.0])
    assert P.candidates(x).tolist() == [1, 3, 6]
    at = P.spaced(P.candidates(x), x[P.candidates(x)], 1)
    assert at[P.prominences(x, at) >= 2].tolist() == [1, 3]
    y = np.array([0, 3, 0, 4, 0.0])
    assert P.spaced(P.candidates(y), y[P.candidates(y)], 3).tolist() == [3]
    assert P.candidates(np.array([1.0, 3, 3, 1])).tolist() == [1] and not len(P.candidates(np.ones(9)))
    d = spark.createDataFrame([("a", i, float(i), float(v)) for i, v in enumerate(x)] + [("two", 0, 0.0, 1.0)], "stream_id string, bin long, time_seconds double, frequency double")
    assert sorted(r.bin for r in P.peaks(d, step=1, window=2, prominence=2).collect()) == [1, 3]
    assert sorted(r.bin for r in P.local_maxima(d).collect()) == [1, 3, 6]


def test_segments():
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, 50), np.random.default_rng(1).normal(8, 1, 50)])
    assert (0, 50) in [(a, b) for a, b in G.segment(x, 6.0, 5)]
    assert G.split_at(np.array([0.0] * 5 + [1.0] * 5), 5) == (0, -1.0)


def iv(spark, rows):
    return spark.createDataFrame([("a", i, float(s), float(e)) for i, (s, e) in enumerate(rows)], "stream_id string, id long, start double, end double")


def test_intervals(spark):
    assert sorted((r.start, r.end) for r in I.union(iv(spark, [(0, 5), (5, 8), (10, 12)])).collect()) == [(0, 8), (10, 12)]
    assert I.overlap(iv(spark, [(0, 10)]), iv(spark, [(-5, 2), (4, 6), (9, 20)]), 3.0).first().covered == 5
    p = spark.createDataFrame([("a", 0, 10.0)], "stream_id string, id long, time_seconds double")
    t = spark.createDataFrame([("a", 8.0, 0), ("a", 12.0, 1)], "stream_id string, at double, order long")
    assert I.nearest(p, t, 3.0, "x").first().x == 8 and I.nearest(p, t, None, "x").first().x == 8 and I.nearest(p, t, 1.0, "x").first().x is None
    rough, sent = iv(spark, [(10, 40)]), iv(spark, [(10, 10.2), (60, 70)])
    r = I.snap(rough, sent, max_snap=35).first()
    assert (r.start, r.end) == (10, 40) or r.end - r.start >= 0.5
    assert I.clips(p, 30, 30).first().start == 0


def test_text(spark):
    c = spark.createDataFrame([("a", float(i), i + 1.0, t) for i, t in enumerate(["a", "a b", "a b", "c"])], "stream_id string, start double, end double, text string")
    assert [(r.start, r.end, r.text) for r in T.chunks(c).orderBy("start").collect()] == [(0, 1, "a"), (1, 3, "b"), (3, 4, "c")]
    g = spark.sql("select 'The cat, sat on a mat' t").select(T.ngrams(T.tokens(F.col("t")))).first()[0]
    assert g == ["the cat sat", "cat sat on", "sat on mat"]


def test_vote_equals_brute_force(spark):
    """Ties, repeats, nulls, a very common n-gram, chunks near their neighbours' bins; over all streams and in the own stream."""
    rng = random.Random(7)
    words = ["hot"] * 6 + [f"g{i}" for i in range(12)] + [None]
    grams = [(s, f"{s}{k}", rng.choice(words)) for s in "ab" for k in range(6) for _ in range(rng.randrange(1, 9))] + [("a", None, "hot"), (None, "n0", "g1")]
    index = [(rng.choice(["a", "b", None]), rng.choice(words), rng.choice([None, *(x / 2 for x in range(120))]), i) for i in range(300)]
    index += index[:40]
    g = spark.createDataFrame(grams, "stream_id string, window_id string, ngram string")
    i = spark.createDataFrame(index, "stream_id string, ngram string, chunk_start double, chunk_idx long")

    def brute(same):
        out = set()
        for w in {w for _, w, _ in grams if w}:
            mine = [x for x in grams if x[1] == w]
            for s in "ab":
                hits = [(c[2], c[3]) for x in mine for c in index if x[2] and x[2] == c[1] and c[0] == s and c[2] is not None and (not same or x[0] == s)]
                if not hits:
                    continue
                bins = Counter(int(t // 10) for t, _ in hits)
                b, v = min(bins.items(), key=lambda kv: (-kv[1], kv[0]))
                near = Counter(h for h in hits if b * 10 - 5 <= h[0] <= (b + 1.5) * 10)
                top = min(near.items(), key=lambda kv: (-kv[1], kv[0][1]))[0]
                out.add((w, s, b, v, len(mine), v / len(mine), *top))
        return out

    assert {tuple(r) for r in T.vote(g.drop("stream_id"), i).collect()} == brute(False)
    assert {tuple(r) for r in T.vote(g, i).collect()} == brute(True)
    assert T.vote(g.limit(0), i).count() == T.vote(g, i.limit(0)).count() == 0


def test_align_equals_joined_votes(spark, monkeypatch):
    """Streams long and short, repeated n-grams, texts without words and in brackets, null streams; in blocks of few pairs too."""
    rng = random.Random(11)
    words = ["so", "hot", "it's", "now", "a", "go"]
    rows = []
    for s, m in (("long", 90), ("mid", 12), ("one", 1), ("two", 2), (None, 3)):
        for i in range(m):
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 5, 9])))
            rows.append((s, i * 7.0, i * 7.0 + rng.choice([7.0, 7.0, 3.0]), rng.choice([text, text, f"[{text}]", f"♪ {text} ♪", "♪"])))
    ch = spark.createDataFrame(rows, "stream_id string, start double, end double, text string")
    names = ["stream_id", "t", "votes", "total", "confidence", "chunk_start"]
    found = lambda d: sorted(tuple(r) for r in d.select(*names).collect())
    want = found(T.align(ch, many=0))
    assert len(want) > 60 and found(T.align(ch)) == want == found(T.align(ch, many=20))
    monkeypatch.setattr(T, "PAIRS", 50)
    mine = sorted((r for r in rows if r[0] == "long"), key=lambda r: r[1:])
    toks = [[w for w in r[3].replace("♪", "").replace("[", "").replace("]", "").split() if len(w) > 1] for r in mine]
    wrapped = lambda r, a, b: r[3][:1] == a and r[3][-1:] == b and len(r[3]) > 1
    speech = np.array([len(x) > 1 and not wrapped(r, "[", "]") and not wrapped(r, "♪", "♪") for x, r in zip(toks, mine)])
    edges = [np.array([r[3][i : i + 1 or None] == c for r in mine]) for i, c in ((0, "["), (-1, "]"), (0, "♪"), (-1, "♪"))]
    start = np.array([r[1] for r in mine])
    t, votes, total, at = T._votes(start, np.array([r[2] for r in mine]), T.pa.array(toks), speech, edges, 30, 5, 15, 10.0, 3)
    assert sorted(zip(t, votes, total, start[at])) == [(r[1], r[2], r[3], r[5]) for r in want if r[0] == "long"]


def test_tokens(spark):
    texts = ["It's  a\tTEST, of--words\n(x) yz!", " ÀB c\u00a0d e\u2003ff ", "", None, "'' -- ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.tokens(F.col("text")).alias("w"), T.ngrams(T.tokens(F.col("text"))).alias("g")).collect()
    for r in rows:
        if r.text is None:
            assert r.w is None
            continue
        w = [x for x in (re.sub("[^a-z0-9']", "", p) for p in re.split(r"[ \t\n\x0b\f\r]+", r.text.lower())) if len(x) > 1]
        assert r.w == w and r.g == [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]


def test_ncc_finds_the_true_lag(spark):
    x = np.random.default_rng(2).normal(size=(80, 8))
    f = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "frame long, v array<double>").select("frame", V.zscore(F.col("v")).alias("z"))
    best = V.best_lag(V.ncc(f.where("frame between 50 and 59").withColumn("frame", F.col("frame") - 50), f, 10)).collect()
    assert [(r.r, r.k) for r in best] == [(0, 50)]


def test_ncc_in_blocks_equals_brute_force(spark):
    x = np.random.default_rng(4).normal(size=(70, 6))
    x[45:57] = x[8:20]
    z = (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-8)
    there = [i for i in range(70) if i != 33]
    f = spark.createDataFrame([(i, [float(v) for v in z[i]]) for i in there], "frame long, z array<double>")
    sim = z @ z.T / 6
    want = {(r, k): np.mean([sim[r + w, k + w] for w in range(10)]) for r in range(61) for k in range(61) if not {33} & {*range(r, r + 10), *range(k, k + 10)}}
    got = {(r.r, r.k): r.ncc for r in V._blocks(f, f, 10, 1, best=False, block=16).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    best = {}
    for (r, k), v in want.items():
        best[r] = max(best.get(r, (-9, 0)), (round(v, 9), -k))
    rows = V.best_lag(V._blocks(f, f, 10, 1, best=True, block=16)).collect()
    assert {(r.r, r.k) for r in rows} == {(r, -k) for r, (v, k) in best.items() if v >= 0.3}


def test_ncc_rounds_as_spark_and_deals_cells_evenly(spark):
    x = np.random.default_rng(8).integers(-2, 3, size=(400, 4)) / 4.0
    x[7, 2] = np.nan
    f = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "frame long, z array<double>")
    plain = V._blocks(f, f, 5, 1, best=False, block=16)
    got, want = ({(r.r, r.k): r.ncc for r in d.collect()} for d in (V._blocks(f, f, 5, 1, best=False, block=16, digits=3), plain.withColumn("ncc", F.round("ncc", 3))))
    assert len(want) == (396 - 5) ** 2 and got == want
    assert any(str(r.ncc)[-1] == "5" and len(str(r.ncc)) == 6 for r in plain.limit(5000).collect())  # halves are met
    cells, height, breadth = V._spread(f, f, 5, 16)
    rows = [r.n for r in cells.where("side = 0").groupBy(F.spark_partition_id()).agg(F.count_distinct("ct", "cs").alias("c"), F.count("*").alias("n")).where("c > 0").collect()]
    assert len(rows) >= 13 * 13 and max(rows) <= height + 4 and height == breadth == 32


def test_best_lags_of_windows_in_the_stream_need_no_pairs(spark):
    """Copies, near copies, constant and missing vectors; template and stream alike and not: as all pairs have it."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(260, 8))
    x[100:130] = x[20:50]
    x[150:180] = x[20:50] + rng.normal(size=(30, 8)) * 1e-7
    x[200:215], x[230, 3] = 1.0, np.nan
    frames = lambda y: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(y)], "frame long, v array<double>").select("frame", V.zscore(F.col("v")).alias("z"))
    f, g = frames(x).where("frame <> 77"), frames(np.concatenate([x[18:60], rng.normal(size=(30, 8)), x[195:220]]))
    found = lambda d: {(r.r, r.k, round(r.ncc, 8)) for r in d.collect()}
    for t, hop in ((f, 1), (g, 1), (g, 3)):
        want = found(V.best_lag(V._blocks(t, f, 6, hop, best=True, block=32)))
        assert found(V.ncc_best_lag(t, f, 6, hop, few=0)) == want and len(want) > 10
        sure = found(V._sure(t, f, 6, hop)[1])
        assert sure and sure <= want
    t, sure = V._sure(f.where("frame between 0 and 19"), f, 6, 1)
    assert t.count() == sure.count() == 15


def test_overlap_sums_equal_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", i, float(s), float(s + n)) for i, (s, n) in enumerate(zip(rng.integers(-50, 400, 200), rng.integers(0, 90, 200)))]
    d = spark.createDataFrame(rows, "stream_id string, id long, start double, end double")
    got = {r.id: r.covered for r in I.overlap_sums(d, d, 60.0).collect()}
    assert got == {i: sum(max(0.0, min(e, f) - max(s, t)) for j, _, t, f in rows if j == k) for k, i, s, e in rows}


def test_overlap_sums_have_a_window_row_per_time(spark):
    """Many intervals on few times, with null and repeated ids; each row is looked up for itself."""
    rng = np.random.default_rng(10)
    rows = [("a", None if i % 5 == 0 else i // 2, float(s), float(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 9, 400), rng.integers(-1, 4, 400)))] + [("a", 999, None, 3.0), (None, 1, 0.0, 5.0)]
    d = spark.createDataFrame(rows, "stream_id string, id long, start double, end double")
    whole = [r for r in rows if r[0] and r[2] is not None and r[3] > r[2]]
    want = [(r, sum(max(0.0, min(r[3], f) - max(r[2], t)) for _, _, t, f in whole) if r in whole else 0.0) for r in rows]
    key = lambda x: str(x)
    out = I.overlap_sums(d, d, 4.0)
    assert sorted((((r.stream_id, r.id, r.start, r.end), r.covered) for r in out.collect()), key=key) == sorted(want, key=key)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [x.end() for x in re.finditer(r"Window \[", plan)]
    assert windows and all("Aggregate [stream_id" in plan[x:] for x in windows)


def test_queries_run_over_whole_tables(spark, tmp_path):
    import datetime

    import __spark_entry__ as e

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    spark.createDataFrame([("N", i, day(2 * i)) for i in range(1, 21)], "l_returnflag string, l_orderkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    x = np.random.default_rng(6).normal(size=(30, 8))
    spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: e.queries()[name](spark, str(tmp_path))
    assert run("interval_union").count() == 20
    assert {(r.id, r.covered) for r in run("overlap_seconds").collect()} == {(i, 1.0) for i in range(1, 21)}
    assert run("ncc_diagonal").count() == 21 * 21
    assert [(r.r, r.k) for r in run("ncc_best_lag").orderBy("r").collect()] == [(i, i) for i in range(21)]
    assert run("ncc_clusters").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text("video_time\tauthor\tmessage\textra\n0:01\t@a\thello\tx\n1:00:05\t@b\twow\ty\n")
    assert sorted((r.stream_id, r.seconds) for r in R.chat_tsv(spark, str(tmp_path / "s1.tsv")).collect()) == [("s1", 1), ("s1", 3605)]

    def line(time, author, runs, kind="liveChatTextMessageRenderer"):
        m = {"timestampText": {"simpleText": time}, "message": {"runs": runs}} | ({"authorName": {"simpleText": author}} if author else {})
        return json.dumps({"replayChatItemAction": {"actions": [{"addChatItemAction": {"item": {kind: m}}}]}})

    lines = [line("0:05", "x", [{"text": "hi"}, {"emoji": {"shortcuts": [":a:", ":b:"]}}]), "{bad", line("0:06", None, [{"text": "yo"}]), line("-0:03", "x", [{"text": "no"}]), line("0:07", "x", [{"text": "paid"}], "liveChatPaidMessageRenderer")]
    (tmp_path / "live.json").write_text("\n".join(lines))
    assert sorted((r.seconds, r.author, r.message) for r in R.live_chat(spark, str(tmp_path / "live.json")).collect()) == [(5, "x", "hi :a:"), (6, "Unknown", "yo")]
    (tmp_path / "c.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nhello\nthere\n\nbroken\nblock\n\n00:03.0 --> 00:04.0\n\nlate text\n\n")
    assert sorted((r.idx, r.start, r.end, r.text) for r in R.subtitles(spark, str(tmp_path / "c.srt")).collect()) == [(0, 3.0, 4.0, "late text"), (1, 1.0, 2.5, "hello\nthere")]


def test_entry_imports():
    import __spark_entry__ as e

    assert len([q for q in e.queries() if not q.startswith("op")]) >= 45 and set(e.oracle_sql()) <= set(e.queries())
