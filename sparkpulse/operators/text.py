"""Captions and text alignment: rolling-caption removal, sentences, n-gram index and window voting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkpulse.functions.arrays import bind

from .series import KEY


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    # one replacement over the whole text: blanks stay, so words split as before it
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9'\s]+", ""), r"\s+"), lambda w: F.length(w) > 1)


def ngrams(toks: Column, n: int = 3) -> Column:
    def grams(t: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(t) - n)), lambda i: F.concat_ws(" ", *(F.get(t, i + j) for j in range(n))))
        return F.when(F.size(t) >= n, all_).otherwise(F.array().cast("array<string>"))

    return bind(toks, grams)


def is_speech(c: Column) -> Column:
    t = F.trim(c)
    return ~(t.rlike(r"(?s)^\[.*\]$") | t.rlike("(?s)^♪.*♪$")) & (F.size(tokens(c)) >= 2)


def chunks(cues: DataFrame, short: float = 0.05) -> DataFrame:
    """stream_id, start, end, text of cues (stream_id, start, end, text) without what rolling captions repeat."""
    w = Window.partitionBy(KEY).orderBy("start", "end")
    d = cues.withColumn("text", clean(F.col("text"))).where("text <> ''")
    d = d.withColumn("prev", F.lag("text").over(w)).withColumn("last", F.max_by("end", F.struct("start", "end")).over(Window.partitionBy(KEY)))
    suffix = F.trim(F.expr("substring(text, length(prev) + 1)"))
    new = F.when(F.col("prev").isNull(), F.col("text")).when(F.col("text") == F.col("prev"), F.lit("")).when(F.col("text").startswith(F.col("prev")), suffix).otherwise(F.col("text"))
    d = d.withColumn("new", new).where((F.col("end") - F.col("start") >= short) & (F.col("new") != ""))
    return d.select(KEY, "start", F.coalesce(F.lead("start").over(w), F.col("last")).alias("end"), F.col("new").alias("text"))


def offsets(ch: DataFrame) -> DataFrame:
    """Chunks with char_start and char_end in the stream's text joined by blanks."""
    w = Window.partitionBy(KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    d = ch.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))
    return d.withColumn("char_end", F.col("char_start") + F.length("text"))


SENTENCE = r"(?<=[.!?])(?<!\b[A-Z]\.)\s+"


def split_sentences(ch: DataFrame) -> DataFrame:
    """Chunks cut into sentences, each with an equal share of the chunk's time."""
    d = ch.withColumn("parts", F.filter(F.split("text", SENTENCE), lambda x: x != "")).withColumn("n", F.size("parts"))
    d = d.select("*", F.posexplode("parts").alias("i", "sentence"))
    each = (F.col("end") - F.col("start")) / F.col("n")
    return d.select(KEY, (F.col("start") + F.col("i") * each).alias("start"), (F.col("start") + (F.col("i") + 1) * each).alias("end"), F.col("sentence").alias("text"))


def sentences(ch: DataFrame) -> DataFrame:
    """Sentence intervals of a stream's whole text: from the start of the chunk where one begins to the end of that where it ends."""
    c = offsets(ch)
    w = Window.partitionBy(KEY)
    # Sentences end inside chunks or at their ends, so each chunk is cut on its own and the pieces up to an end are summed up.
    d = c.withColumn("parts", F.filter(F.split("text", SENTENCE), lambda x: x != ""))
    d = d.select(KEY, "start", "end", F.posexplode("parts").alias("i", "part"))
    up = w.orderBy("start", "end", "i")
    d = d.withColumn("ends", F.col("part").rlike(r"[.!?][\"')\]]*$").cast("int"))
    d = d.withColumn("g", F.coalesce(F.sum("ends").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = d.groupBy(KEY, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "i", "part"))), lambda x: x["part"]), " ").alias("text"))
    p = w.orderBy("start", "end", "g")
    near = (F.abs(F.col("start") - F.lag("start").over(p)) < 0.01) & (F.abs(F.col("end") - F.lag("end").over(p)) < 0.01)
    return s.withColumn("near", F.coalesce(near, F.lit(False))).where("not near").select(KEY, "start", "end", "text")


def ngram_index(ch: DataFrame, n: int = 3) -> DataFrame:
    """stream_id, ngram, chunk_start, chunk_idx of speech chunks (stream_id, idx, start, text)."""
    c = ch.where(is_speech(F.col("text")))
    return c.select(KEY, F.explode(ngrams(tokens(F.col("text")), n)).alias("ngram"), F.col("start").alias("chunk_start"), F.col("idx").alias("chunk_idx"))


def windows(ch: DataFrame, window: float = 30, hop: float = 5, least: float = 15) -> DataFrame:
    """stream_id, t, text: concatenated chunks of sliding windows up to the last chunk's end less ``least``."""
    ends = ch.groupBy(KEY).agg(F.max("end").alias("dur"))
    w = ends.select(KEY, "dur", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("dur") - least) / hop).cast("int") - 1))).alias("k")).select(KEY, (F.col("k") * hop).cast("double").alias("t"), F.least(F.col("k") * hop + window, F.col("dur")).alias("t_end"))
    w = w.withColumn("__b", F.explode(F.sequence(F.floor(F.col("t") / window), F.floor(F.col("t_end") / window))))
    c = ch.select(KEY, "start", "end", "text").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor(F.col("end") / window))))
    first = F.floor(F.greatest("t", "start") / window) == F.col("__b")
    j = w.join(c, [KEY, "__b"]).where((F.col("end") > F.col("t")) & (F.col("start") < F.col("t_end")) & first)
    return j.groupBy(KEY, "t").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "text"))), lambda x: x["text"]), " ").alias("text"))


def vote(grams: DataFrame, index: DataFrame, bin_seconds: float = 10.0) -> DataFrame:
    """grams (window_id, ngram) against index (stream_id, ngram, chunk_start, chunk_idx): window_id, stream_id, bin, votes, total,
    confidence, chunk_start, chunk_idx.  The bin with most votes wins (of equals the first), then the chunk with most near it.

    Where grams has a stream_id, windows are held against their own stream only.  Null windows, streams and starts have no votes.
    A chunk is near its own bin and the neighbours within half a bin, so votes and nearest chunks come from one join and
    aggregations that combine before each shuffle; no window's or stream's rows are gathered."""
    own = [KEY] if KEY in grams.columns else []
    there = index.where(F.col(KEY).isNotNull() & F.col("chunk_start").isNotNull())
    hits = grams.where("window_id is not null").join(there, [*own, "ngram"])
    counts = hits.groupBy("window_id", KEY, "chunk_idx", "chunk_start").agg(F.count("*").alias("c"))
    start, home = F.col("chunk_start"), F.floor(F.col("chunk_start") / bin_seconds)
    spread = counts.withColumn("home", home).withColumn("bin", F.explode(F.array(*(F.col("home") + i for i in (-1, 0, 1)))))
    spread = spread.where((start >= F.col("bin") * bin_seconds - bin_seconds / 2) & (start <= (F.col("bin") + 1.5) * bin_seconds))
    votes = F.sum(F.when(F.col("bin") == F.col("home"), F.col("c"))).alias("votes")
    near = F.max_by(F.struct("chunk_start", "chunk_idx"), F.struct("c", F.negative("chunk_idx"))).alias("x")
    bins = spread.groupBy("window_id", KEY, "bin").agg(votes, near).where("votes > 0")
    best = bins.groupBy("window_id", KEY).agg(F.max_by(F.struct("bin", "votes", "x"), F.struct("votes", F.negative("bin"))).alias("b")).select("window_id", KEY, "b.*")
    total = grams.groupBy("window_id").agg(F.count("*").alias("total"))
    return best.join(total, "window_id").select("window_id", KEY, "bin", "votes", "total", (F.col("votes") / F.col("total")).alias("confidence"), "x.*")


#: Chunks of a stream up to which one task votes for its windows, and pairs of a gram and a chunk that it holds at once.
MANY, PAIRS = 20_000, 4_000_000


def align(ch: DataFrame, window: float = 30, hop: float = 5, least: float = 15, bin_seconds: float = 10.0, n: int = 3, many: int = MANY) -> DataFrame:
    """vote() of each stream's speech windows() for its own chunks, not blank and with ends in order as chunks() has them: stream_id, t, votes, total,
    confidence, chunk_start.

    A stream's chunks go to one task, and no n-gram leaves it; those of streams with more than ``many`` chunks are joined."""
    over = ch.groupBy(KEY).count().where(F.col("count") > many).select(KEY)
    toks, trimmed = tokens(F.col("text")), F.trim("text")
    d = ch.where(F.col(KEY).isNotNull() & F.col("start").isNotNull())
    if over.isEmpty():
        short, joined = d, None
    else:
        short, long = d.join(over, KEY, "left_anti"), d.join(over, KEY, "left_semi")
        w = windows(long, window, hop, least).where(is_speech(F.col("text")))
        grams = w.select(KEY, F.struct(KEY, "t").alias("window_id"), F.explode(ngrams(tokens(F.col("text")), n)).alias("ngram"))
        index = ngram_index(long.withColumn("idx", F.row_number().over(Window.partitionBy(KEY).orderBy("start", "end", "text"))), n)
        joined = vote(grams, index, bin_seconds).select(KEY, "window_id.t", "votes", "total", "confidence", "chunk_start")
    edges = [trimmed.rlike(x).alias(f"e{i}") for i, x in enumerate((r"^\[", r"(?s)\]$", "^♪", "(?s)♪$"))]
    short = short.select(KEY, "start", "end", "text", toks.alias("toks"), is_speech(F.col("text")).alias("speech"), *edges)

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("end", "ascending"), ("text", "ascending")]).combine_chunks()
        col = lambda c: table.column(c).to_numpy()
        start, words = col("start"), table.column("toks").combine_chunks()
        t, votes, total, at = _votes(start, col("end"), words, col("speech"), [col(f"e{i}") for i in range(4)], window, hop, least, bin_seconds, n)
        return pa.table({KEY: pa.array([key[0].as_py()] * len(t), pa.string()), "t": t, "votes": votes, "total": total, "confidence": votes / total, "chunk_start": start[at]})

    out = short.groupBy(KEY).applyInArrow(run, f"{KEY} string, t double, votes long, total long, confidence double, chunk_start double")
    return out if joined is None else out.unionByName(joined)


def _sums(keys: list[np.ndarray], size: list[int], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of values by keys below size, in the order of the keys."""
    one = np.ravel_multi_index(keys, size) if len(values) else np.zeros(0, "i8")
    one, back = np.unique(one, return_inverse=True)
    return list(np.unravel_index(one, size)), np.bincount(back, values, len(one)).astype("i8")


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ranges [lo, hi), and what they hold, one after the other."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def _votes(start, end, words: pa.ListArray, speech, edges, window, hop, least, bin_seconds, n) -> tuple[np.ndarray, ...]:
    """t, votes, total and the chunk of windows that any chunk shares n-grams with, of one stream's chunks in order."""
    m, dur = len(start), end.max()
    t = np.arange(max(0, int(np.ceil((dur - least) / hop)) - 1) + 1) * float(hop)
    # A window's chunks are [lo, hi): each chunk ends where the next begins, only the last might end sooner.
    lo, hi = np.searchsorted(end[:-1], t, "right"), np.searchsorted(start, np.minimum(t + window, dur), "left")
    cut = (hi == m) & (end[-1] <= t)
    first = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype("i8")
    stop = np.where(cut, hi - 1, hi)
    size = first[np.maximum(stop, lo)] - first[lo]
    some = np.maximum(np.minimum(stop, m) - 1, 0), np.minimum(lo, m - 1)
    said = (stop > lo) & (size >= 2) & ~(edges[0][some[1]] & edges[1][some[0]]) & ~(edges[2][some[1]] & edges[3][some[0]])
    grams = np.maximum(size - n + 1, 0)
    coded = words.flatten().dictionary_encode()
    token, v = coded.indices.to_numpy(zero_copy_only=False).astype("i8"), max(1, len(coded.dictionary))
    p = max(0, len(token) - n + 1)
    if not p:
        return (np.zeros(0), *(np.zeros(0, "i8") for _ in range(3)))
    gram = token[:p].copy()
    for j in range(1, n):
        gram = np.unique(gram * v + token[j : j + p], return_inverse=True)[1]
    owner = np.repeat(np.arange(m), np.diff(first))
    a, b = owner[:p], owner[n - 1 : n - 1 + p]
    here = (a == b) & speech[a]
    kinds = int(gram.max()) + 1
    (ig, ic), times = _sums([gram[here], a[here]], [kinds, m], np.ones(int(here.sum())))
    at = np.searchsorted(ig, np.arange(kinds + 1))
    load = np.concatenate([[0], np.cumsum(at[gram + 1] - at[gram])])
    home, until = np.floor(start / bin_seconds).astype("i8"), int(np.searchsorted(t, end[-1], "left"))
    home -= home.min() - 1
    shift = np.floor(start / bin_seconds).astype("i8") - home
    out, w0 = [], 0
    while w0 < len(t):
        # windows that together meet no more than PAIRS, or one window
        begins = min(first[lo[w0]], p)
        w1 = int(np.clip(np.searchsorted(load[np.minimum(first[np.maximum(hi, lo)], p)], load[begins] + PAIRS, "right"), w0 + 1, len(t)))
        ends = min(int(first[max(hi[w1 - 1], lo[w1 - 1])]), p)
        x = np.arange(begins, ends)
        which, pair = _ranges(at[gram[x]], at[gram[x] + 1])
        x = x[which]
        (ka, kb, kc), c = _sums([a[x], b[x] - a[x], ic[pair]], [m, int((b - a).max()) + 1, m], times[pair])
        kb += ka
        from_, to = np.maximum(np.searchsorted(hi, kb, "right"), w0), np.minimum(np.searchsorted(lo, ka, "right"), w1)
        to = np.where(kb == m - 1, np.minimum(to, until), to)
        which, w = _ranges(from_, to)
        (w, k), c = _sums([w - w0, kc[which]], [w1 - w0, m], c[which])
        bins = int(home.max()) + 2
        (bw, bb), votes = _sums([w, home[k]], [w1 - w0, bins], c)
        best = np.lexsort((bb, -votes, bw))
        best = best[np.unique(bw[best], return_index=True)[1]]
        won, most = np.full(w1 - w0, -9), np.zeros(w1 - w0, "i8")
        won[bw[best]], most[bw[best]] = bb[best], votes[best]
        real = won[w] + shift[k]
        near = (start[k] >= real * bin_seconds - bin_seconds / 2) & (start[k] <= (real + 1.5) * bin_seconds) & (won[w] >= 0)
        w, k, c = w[near], k[near], c[near]
        order = np.lexsort((k, -c, w))
        w, pick = np.unique(w[order], return_index=True)
        keep = said[w + w0]
        out.append((t[w0 + w][keep], most[w][keep], grams[w0 + w][keep], k[order][pick][keep]))
        w0 = w1
    return tuple(np.concatenate(x) for x in zip(*out))


def offset_clusters(m: DataFrame, *, max_shift: float, max_gap: float, least: int, least_cover: float = 0.0) -> DataFrame:
    """Matches (stream_id, start, end, offset) in runs whose offset and gap stay small: n, start, end, median offset."""
    w = Window.partitionBy(KEY).orderBy("start", "end")
    new = (F.abs(F.col("offset") - F.lag("offset").over(w)) > max_shift) | (F.col("start") - F.lag("end").over(w) > max_gap)
    d = m.withColumn("g", F.sum(F.when(new, 1).otherwise(0)).over(w))
    g = d.groupBy(KEY, "g").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.median("offset").alias("offset"))
    return g.where((F.col("n") >= least) & (F.col("end") - F.col("start") >= least_cover)).drop("g")


#: Typographic and mathematical characters as ASCII.
ASCII = {
    "≥": ">=", "≤": "<=", "≈": "~", "α": "alpha", "→": "->", "【": "[", "】": "]", "｜": "|", "：": ":", "−": "-", "–": "-", "—": "--",
    "Δ": "Delta", "β": "beta", "γ": "gamma", "μ": "mu", "σ": "sigma", "×": "x", "÷": "/", "≠": "!=", "±": "+-", "∈": "in",
    "∞": "infinity", "∑": "sum", "∏": "prod", "√": "sqrt", "∂": "d", "λ": "lambda", "ε": "epsilon", "θ": "theta", "ω": "omega",
    "…": "...", "‧": ".", "•": "*", "·": "*", "・": "*", "²": "^2", "³": "^3", "⁴": "^4",
}


def to_ascii(c: Column) -> Column:
    """c with the characters of ASCII written out; others stay."""
    table = F.create_map(*(F.lit(x) for pair in ASCII.items() for x in pair))
    odd = "[" + "".join(ASCII) + "]"
    return F.when(c.rlike(odd), F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")).otherwise(c)
