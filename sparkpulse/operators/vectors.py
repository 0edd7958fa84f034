"""Loudness and silence, feature frames, and normalised cross-correlation."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY

#: Frames of a block of the similarity matrix, on either side.
BLOCK = 256
#: Cells of the grid that blocks are dealt to, on either side, and the most frames of a cell's side.
GRID, MOST = 16, 32768
#: Pairs of frames up to which all are compared at once; directions and cells along which equal windows look for near ones, how near
#: they look, and the most different windows of a cell that are looked through.
FEW, LINES, CELL, REACH, CROWD = 50_000_000, 6, 0.01, 0.001, 256


def loudness(frames: DataFrame) -> DataFrame:
    """frames (stream_id, frame, rms) with db against the stream's 95th percentile (1 if that is 0)."""
    ref = frames.groupBy(KEY).agg(F.percentile("rms", F.lit(0.95)).alias("ref"))
    r = F.when(F.col("ref") > 0, F.col("ref")).otherwise(F.lit(1.0))
    return frames.join(ref, KEY).withColumn("db", 20 * F.log10(F.greatest(F.col("rms") / r, F.lit(1e-10)))).drop("ref")


def silences(frames: DataFrame, *, threshold_db: float = -45.0, hop: float = 0.01, min_frames: int = 20) -> DataFrame:
    """stream_id, start, end of runs of at least min_frames quiet frames."""
    w = Window.partitionBy(KEY).orderBy("frame")
    d = loudness(frames).where(F.col("db") < threshold_db).withColumn("g", F.col("frame") - F.row_number().over(w))
    r = d.groupBy(KEY, "g").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).where(F.col("b") - F.col("a") + 1 >= min_frames)
    return r.select(KEY, (F.col("a") * hop).alias("start"), ((F.col("b") + 1) * hop).alias("end"))


def zscore(v: Column) -> Column:
    """A vector less its mean, over its population deviation plus 1e-8."""
    n = F.size(v)
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double"))
    m = F.get(F.transform(F.array(v), lambda x: add(x) / n), F.lit(0))
    z = F.transform(F.array(F.struct(v.alias("v"), m.alias("m"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") - s["m"]))
    c = F.get(z, F.lit(0))
    return F.get(F.transform(F.array(c), lambda c: F.transform(F.array(F.sqrt(add(F.transform(c, lambda x: x * x)) / n) + 1e-8), lambda sd: F.transform(c, lambda x: x / sd))), F.lit(0))[0]


def ncc(template: DataFrame, stream: DataFrame, width: int, hop: int = 1, digits: int | None = None) -> DataFrame:
    """Correlation of each window of template frames with each of the stream's: r, k, ncc, from frames (frame, z).

    A window's score is the mean over a diagonal of the similarity matrix, which is worked out block by block: neither side need
    be short.  Frame numbers are unique; windows in which a frame or its vector is missing have no score.  ``digits`` rounds
    scores as F.round does, but block by block: F.round takes longer over a score than all the rest."""
    return _blocks(template, stream, width, hop, best=False, digits=digits)


def ncc_best_lag(template: DataFrame, stream: DataFrame, width: int, hop: int = 1, least: float = 0.30, few: int = FEW) -> DataFrame:
    """best_lag(ncc(...)).  Where there are more than ``few`` pairs of frames, windows that occur in the stream themselves are
    looked up, if that is sure to be their best; only the others are held against every stream frame."""
    n = [d.where("frame is not null").count() for d in (template, stream)]
    if n[0] * n[1] <= few:
        return best_lag(_blocks(template, stream, width, hop, best=True, least=least), least)
    t, sure = _sure(template, stream, width, hop)
    rest = t.select("r").join(sure.select("r"), "r", "left_anti")
    need = rest.select(F.explode(F.sequence("r", F.col("r") + width - 1)).alias("frame")).distinct()
    if need.isEmpty():
        return best_lag(sure, least)
    others = _blocks(template.join(need, "frame", "left_semi"), stream, width, hop, best=True, least=least)
    return best_lag(sure.unionByName(others.join(rest, "r", "left_semi")), least)


def _signatures(d: DataFrame, width: int, hop: int, size: int = 2048) -> DataFrame:
    """Each whole window of frames: r, h (a hash of its vectors), n (its score with itself), p (its places along LINES directions
    of length 1, when scores are products)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r0, _, z, _ in _cells(batches, size, size, width):
            if not z.shape[1]:
                continue
            there, dim = np.isfinite(z).all(axis=1), z.shape[1]
            z = np.where(there[:, None], z, 0.0) + 0.0
            lines = np.random.default_rng(0).normal(size=(dim, width, LINES))
            lines /= np.sqrt((lines**2).sum(axis=(0, 1))) * np.sqrt(dim * width)
            along, own = (z @ lines.reshape(dim, -1)).reshape(len(z), width, LINES), (z * z).sum(axis=1) / (dim * width)
            add = lambda f: sum(f(w) for w in range(width))
            p, n = add(lambda w: along[w : w + size, w]), add(lambda w: own[w : w + size])
            r = np.flatnonzero((add(lambda w: there[w : w + size].astype(int)) == width) & (np.arange(r0, r0 + size) % hop == 0))
            each = [blake2b(row.tobytes(), digest_size=16).digest() for row in z]
            h = pa.array([blake2b(b"".join(each[i : i + width]), digest_size=16).digest() for i in r], pa.binary())
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype="i4") * LINES), pa.array(p[r].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(r + r0), h, pa.array(n[r]), places], names=["r", "h", "n", "p"])

    own = F.floor((F.col("frame") - (width - 1)) / size), F.floor(F.col("frame") / size)
    d = d.where("frame is not null").select(F.explode(F.sequence(*own)).alias("ct"), F.lit(0).alias("cs"), F.lit(0).alias("side"), F.col("frame").cast("long").alias("frame"), F.col("z").cast("array<double>").alias("z"))
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(tasks, "ct").sortWithinPartitions("ct").mapInArrow(run, "r long, h binary, n double, p array<double>")


def _sure(template: DataFrame, stream: DataFrame, width: int, hop: int) -> tuple[DataFrame, DataFrame]:
    """The template's windows (_signatures), and r, k, ncc of those whose best lag is the first stream window equal to them.

    With |a| and |b| for two windows' scores with themselves, |a - b| squared is |a| + |b| less twice their score.  So a window b
    that scores as much as a with itself, at nine digits, is as near to a as |b| - |a| + 2e-9 allows, and nearer still along any
    direction.  Cells of a grid over LINES directions find all windows that may be so near; where there is one, or where a cell
    has more than CROWD different windows, nothing is sure."""
    t, s = _signatures(template, width, hop), _signatures(stream, width, 1)
    s = s.groupBy("h").agg(F.min("r").alias("k"), F.max("n").alias("m"), F.min("p").alias("q"))
    most = F.broadcast(s.agg(F.max("m").alias("most")))
    same = t.join(s.select("h", "k"), "h").crossJoin(most).where(F.col("most") - F.col("n") + 1e-8 <= REACH**2)
    at = same.groupBy("h").agg(F.max("n").alias("n"), F.min("p").alias("p"))
    for i in range(LINES):
        p = F.get("p", F.lit(i))
        at = at.withColumn(f"c{i}", F.explode(F.sequence(F.floor((p - REACH) / CELL), F.floor((p + REACH) / CELL))))
    key = [f"c{i}" for i in range(LINES)]
    at = at.select("h", "n", "p", F.xxhash64(*key).alias("cell"))
    s = s.select(F.col("h").alias("h2"), "m", "q", F.xxhash64(*(F.floor(F.get("q", F.lit(i)) / CELL) for i in range(LINES))).alias("cell"))
    full = s.groupBy("cell").agg(F.count("*").alias("here"))
    crowded = at.join(full.where(F.col("here") > CROWD), "cell", "left_semi").select("h")
    near = F.forall(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), lambda x: x <= F.greatest(F.col("m") - F.col("n"), F.lit(0.0)) + 1e-8)
    close = at.join(s.join(full.where(F.col("here") <= CROWD), "cell", "left_semi"), "cell").where((F.col("h") != F.col("h2")) & near).select("h")
    sure = same.join(crowded.unionByName(close), "h", "left_anti")
    return t, sure.select("r", "k", F.col("n").alias("ncc"))


def _rounded(x: np.ndarray, digits: int, spare: np.ndarray) -> np.ndarray:
    """x to so many digits as F.round has it: halves of the shortest decimal form away from zero.  spare is overwritten."""
    y = np.multiply(x, 10.0**digits, out=spare[: x.shape[0], : x.shape[1]])
    out = np.rint(y)
    np.abs(np.subtract(y, out, out=y), out=y)
    out /= 10.0**digits
    out += 0.0  # no negative zero
    for i in zip(*np.nonzero(y > 0.5 - 1e-6)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _diagonals(sim: np.ndarray, width: int, spare: list[np.ndarray]) -> np.ndarray:
    """Sums over ``width`` steps down each diagonal of sim, by sums that double, in spare's arrays; sim is overwritten."""
    n, m = sim.shape[0] - width + 1, sim.shape[1] - width + 1
    total, have, free, at, left, step = None, sim, spare[0], 0, width, 1
    while True:
        if left & 1:
            part = have[at : at + n, at : at + m]
            if total is None:
                total = spare[1][:n, :m]
                total[:] = part
            else:
                total += part
            at += step
        left >>= 1
        if not left:
            return total
        h, w = have.shape[0] - step, have.shape[1] - step
        have, free = np.add(have[:-step, :-step], have[step:, step:], out=free[:h, :w]), have.base if have.base is not None else have
        step *= 2


def _spread(template: DataFrame, stream: DataFrame, width: int, block: int) -> tuple[DataFrame, int, int]:
    """Frames of both sides dealt to the cells of a grid, one cell per partition: ct, cs, side (0: template), frame, z; and the
    frames of a cell on either side.  A cell also has the first width - 1 frames of the next one.

    Each frame goes to every cell of its row or column, so cells get larger, up to MOST frames, before they get more."""
    ends = [d.agg(F.min("frame"), F.max("frame")).first() for d in (template, stream)]
    blocks = [(e[1] // block - e[0] // block + 1) if e[0] is not None else 1 for e in ends]
    rows = min(GRID, blocks[0])
    size = [min(-(-n // g), max(1, MOST // block)) * block for n, g in ((blocks[0], rows), (blocks[1], min(GRID * GRID // rows, blocks[1])))]

    def cut(d: DataFrame, at: str, size: int) -> DataFrame:
        own = F.floor((F.col("frame") - (width - 1)) / size), F.floor(F.col("frame") / size)
        return d.where("frame is not null").select(F.col("frame").cast("long").alias("frame"), F.col("z").cast("array<double>").alias("z"), F.explode(F.sequence(*own)).alias(at))

    cells = lambda d, at, size: F.broadcast(d.where("frame is not null").select(F.floor(F.col("frame") / size).alias(at)).distinct())
    t = cut(template, "ct", size[0]).crossJoin(cells(stream, "cs", size[1])).withColumn("side", F.lit(0))
    s = cut(stream, "cs", size[1]).crossJoin(cells(template, "ct", size[0])).withColumn("side", F.lit(1))
    across = -(-blocks[1] * block // size[1]) + 1
    tasks = max(1, min((-(-blocks[0] * block // size[0]) + 1) * across, 4000))
    names = ["ct", "cs", "side", "frame", "z"]
    both = t.select(*names).unionByName(s.select(*names))
    return both.repartitionById(tasks, F.pmod(F.col("ct") * across + F.col("cs"), F.lit(tasks)).cast("int")).sortWithinPartitions("ct", "cs"), *size


def _cells(batches: Iterator[pa.RecordBatch], height: int, breadth: int, width: int) -> Iterator[tuple]:
    """Each cell of _spread: the first frames of its sides, and their vectors (nan where missing)."""

    def dense(parts: list, first: int, size: int) -> np.ndarray:
        most = max((int(n.max(initial=0)) for _, n, _ in parts), default=0)
        out = np.full((size + width - 1, most), np.nan)
        for frame, n, z in parts:
            whole = (n == most) & (n > 0)
            if whole.any():
                out[frame[whole] - first] = z.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, most)
        return out

    def done(cell, parts):
        r0, k0 = cell[0] * height, cell[1] * breadth
        return r0, k0, dense(parts[0], r0, height), dense(parts[1], k0, breadth)

    cell, parts = None, ([], [])
    for b in batches:
        at = [b.column(c).to_numpy(zero_copy_only=False) for c in ("ct", "cs", "side")]
        cuts = [0, *(np.flatnonzero((np.diff(at[0]) != 0) | (np.diff(at[1]) != 0) | (np.diff(at[2]) != 0)) + 1), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            here = int(at[0][lo]), int(at[1][lo])
            if here != cell:
                if cell is not None:
                    yield done(cell, parts)
                cell, parts = here, ([], [])
            z = b.column("z").slice(lo, hi - lo)
            n = z.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            parts[at[2][lo]].append((b.column("frame").slice(lo, hi - lo).to_numpy(zero_copy_only=False), n, z))
    if cell is not None:
        yield done(cell, parts)


def _blocks(template: DataFrame, stream: DataFrame, width: int, hop: int, best: bool, block: int = BLOCK, digits: int | None = None, least: float = -np.inf) -> DataFrame:
    cells, height, breadth = _spread(template, stream, width, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare = [np.empty((block + width - 1,) * 2) for _ in range(3)]  # new arrays for each block cost more than the sums
        for r0, k0, t, s in _cells(batches, height, breadth, width):
            if not t.shape[1] or t.shape[1] != s.shape[1]:
                continue
            there_t, there_s = (~np.isnan(x).all(axis=1) for x in (t, s))
            for i in range(0, height, block):
                if not there_t[i : i + block].any():
                    continue
                x = np.flatnonzero(np.arange(r0 + i, r0 + i + block) % hop == 0)
                for j in range(0, breadth, block):
                    if not len(x) or not there_s[j : j + block].any():
                        continue
                    np.matmul(t[i : i + block + width - 1], s[j : j + block + width - 1].T, out=spare[0])
                    score = _diagonals(spare[0], width, spare[1:])
                    score /= t.shape[1] * width
                    if hop > 1:
                        score = score[x]
                    if best:
                        score[np.isnan(score)] = -np.inf
                        top = score.max(axis=1)
                        ok = np.flatnonzero((top >= least - 1e-8) & np.isfinite(top))
                        y = (score >= (top - 2e-9)[:, None]).argmax(axis=1)[ok]
                        for a in np.flatnonzero(np.round(score[ok, y], 9) != np.round(top[ok], 9)):
                            y[a] = _first(score[ok[a]], top[ok[a]])
                        yield pa.RecordBatch.from_arrays([pa.array(x[ok] + r0 + i), pa.array(y + k0 + j), pa.array(top[ok])], names=["r", "k", "ncc"])
                        continue
                    gone = None if np.isfinite(score).all() else ~np.isfinite(score)
                    if gone is not None:
                        score[gone] = 0.0
                    out = score.copy() if digits is None else _rounded(score, digits, spare[0])
                    values = pa.array(out.ravel(), mask=None if gone is None else gone.ravel())
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * block), values)
                    yield pa.RecordBatch.from_arrays([pa.array(x + r0 + i), pa.array(np.full(len(x), k0 + j)), rows], names=["r", "k0", "scores"])

    if best:
        return cells.mapInArrow(run, "r long, k long, ncc double")
    rows = cells.mapInArrow(run, "r long, k0 long, scores array<double>")
    return rows.select("r", "k0", F.posexplode("scores").alias("at", "ncc")).where("ncc is not null").select("r", (F.col("k0") + F.col("at")).alias("k"), "ncc")


def _first(score: np.ndarray, top: float) -> int:
    """The first place whose score is equal to top at nine digits."""
    at = np.flatnonzero(score >= top - 2e-9)
    return at[0] if len(at) == 1 else at[np.round(score[at], 9).argmax()]


def best_lag(scores: DataFrame, least: float = 0.30) -> DataFrame:
    """Each template window's best stream frame (of equals the first) and its score."""
    b = scores.groupBy("r").agg(F.max_by("k", F.struct(F.round("ncc", 9), F.negative("k"))).alias("k"), F.max("ncc").alias("ncc"))
    return b.where(F.col("ncc") >= least)


def envelope_ncc(series: DataFrame, templates: DataFrame, size: int, value: str = "value") -> DataFrame:
    """stream_id, bin, ncc: the normalised correlation of each window of ``size`` bins that begins at bin with the stream's
    template (an array column of ``size`` values), within -1 and 1; 0 for a constant template or window."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("bin").rowsBetween(0, size - 1)
    x = series.select("stream_id", "bin", F.collect_list(F.col(value).cast("double")).over(w).alias("x")).where(F.size("x") == size)  # size values
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / size
    x = x.join(F.broadcast(templates.select("stream_id", "template")), "stream_id")  # a short array per stream
    x = x.withColumn("mx", mean(F.col("x"))).withColumn("mt", mean(F.col("template")))
    x = x.withColumn("sx", F.sqrt(mean(F.transform("x", lambda v: (v - F.col("mx")) ** 2)))).withColumn("st", F.sqrt(mean(F.transform("template", lambda v: (v - F.col("mt")) ** 2))))
    both = mean(F.zip_with("x", "template", lambda a, b: (a - F.col("mx")) * (b - F.col("mt"))))
    ncc = F.when((F.col("sx") < 1e-9) | (F.col("st") < 1e-9), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both / (F.col("sx") * F.col("st")))))
    return x.select("stream_id", "bin", ncc.alias("ncc"))
