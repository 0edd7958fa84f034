"""Exact n-gram Jaccard self-join by universe partitioning, the pigeonhole principle and one-deletion neighbourhoods.

A document is the set of its word n-grams (64-bit hashes).  Sets fall into bands by size, so that partners at the threshold
stand in the same or in neighbouring bands.  In the scheme of band k two partners, the smaller one in band k, differ in at most
H tokens.  Hashing cuts the token universe into m segments; every segment in which they don't differ is an equal subset.

Cost-based allocation.  The subsets of all segments are counted first.  A segment may get threshold -1 (not looked up), 0 (equal
subsets) or 1 (one-deletion neighbourhoods meet); if the sum of threshold + 1 exceeds H, one segment of any partner meets.
Each set takes its H + 1 cheapest segments at 0, the cost being the number of sets that share the subset, and gives -1 to the
rest.  A set whose full segments don't reach H + 1 gets threshold 1, with about half the segments, and prefix tokens where even
that isn't enough.  Costs and allocation are worked out anew for the sets that are left after each of the steps below.

Filters.  A set that shares fewer than (full segments - H) subsets with others has no partner.  Neither has one of whose tokens
less than the threshold's share is found in the sets of other components.

Verification.  Each set is verified against one other, the first of the buckets that most of its segments are in; linked sets
are one component from there on.  What is left, buckets of unlike components whose sets pass both filters, falls into clusters
of sets that share buckets.  Clusters are cut into chunks of a bounded number of sets and tokens, and each pair of chunks is
compared in one task by counting common tokens; chunks of one component aren't compared with themselves.  Only links
leave a task.

Equal sets are one vertex, named by a 64-bit hash of its tokens; no row numbers are used, so the input may be split in any way.
Null and empty texts, and texts without words, have no n-grams and link with nothing.  Fewer words than n make one n-gram.
Repeated ids are rows of their own; a null id is never a component's smallest unless all are null.  Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, trim
from .components import components

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
#: Keys that are sent to every executor at most; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Tokens that are cut into segments at once, and entries that are packed together: bounds of a worker's memory.
CUT, FLUSH = 200_000, 600_000
#: Documents whose entries one task gathers, about.
GATHER = 8000
#: Sets and tokens of a chunk, about.
CHUNK_SETS, CHUNK_TOKENS = 256, 150_000
#: The last bits of a signature's name: the parity of its scheme, or a neighbourhood.
NEAR = 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_table = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(text: str) -> np.ndarray:
    raw = _fold[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~_blank[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(12, (len(raw) - 1).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_table[raw] * up[: len(raw)], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngrams(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    size = min(n, len(w))
    s = w[: len(w) - size + 1] + U(size)
    for k in range(1, size):
        s = mix(s * U(BASE)) + w[k : len(w) - size + 1 + k]
    return np.unique(mix(s))


class Schemes:
    """Bands of set sizes and the partition of each, for a threshold num / den."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den
        self.starts = [1, 2]
        while self.starts[-1] < 1 << 31:
            self.starts.append(max(self.starts[-1] + 1, (self.starts[-1] - 1) * den // num + 1))

    def band(self, size: int) -> int:
        return bisect_right(self.starts, size) - 1

    def differ(self, k: int) -> int:
        """Tokens in which partners can differ, the smaller being in band k."""
        return (self.den - self.num) * (self.starts[k + 1] - 1) // self.num

    def segments(self, k: int) -> int:
        """H + 1, and some that may be empty or crowded."""
        h = self.differ(k)
        return h + 4 + math.ceil(0.2 * h)

    def of(self, size: int) -> list[int]:
        """Schemes in which a set takes part: that of its band and of the band below.  Without differences equality is all."""
        k = self.band(size)
        return [j for j in (k, k - 1) if j >= 0 and self.differ(j) > 0]

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        if self.den * small < self.num * large:
            return False
        both = np.sort(np.concatenate([a, b]))
        common = int((both[1:] == both[:-1]).sum())
        return self.den * common >= self.num * (small + large - common)


def node_of(s: np.ndarray) -> int:
    """The name of a set."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ U(BASE)).sum(dtype=np.uint64)
    return int(mix(np.array([a ^ mix(np.array([b + U(len(s))]))[0]]))[0].view(np.int64))


def signatures(sets: list[np.ndarray], ks: list[int], sch: Schemes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, index of the set, full segments of each set) with set i cut by scheme ks[i]."""
    m = np.array([sch.segments(k) for k in ks], np.int64)
    base = np.concatenate([[0], np.cumsum(m)])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets)
    h = mix(tokens ^ (np.array(ks, np.uint64)[owner] * U(BASE)))
    seg = base[owner] + (h % m.astype(np.uint64)[owner]).astype(np.int64)
    h = mix(h)
    lo = np.bincount(seg, (h & U(0xFFFFFFFF)).astype(np.float64), int(base[-1])).astype(np.uint64)
    hi = np.bincount(seg, (h >> U(32)).astype(np.float64), int(base[-1])).astype(np.uint64)
    full = np.bincount(seg, minlength=int(base[-1])) > 0
    of = np.repeat(np.arange(len(sets)), m)
    local = np.arange(int(base[-1])) - base[of]
    sig = mix((lo + (hi << U(32))) ^ mix(np.array(ks, np.uint64)[of] * U(1 << 32) + local.astype(np.uint64)))
    sig = sig & ~U(3) | (np.array(ks, np.uint64)[of] & U(1))
    return sig[full], of[full], np.bincount(of[full], minlength=len(sets))


def neighbourhoods(s: np.ndarray, k: int, sch: Schemes) -> np.ndarray:
    """Signatures of one set at threshold 1 everywhere, with prefix tokens where too many segments are too small."""
    h = sch.differ(k)
    spare = 2 + math.ceil(0.1 * h)
    m = -(-(h + 1 + spare) // 2)
    g = mix(s ^ U((k * BASE + 7) & (2**64 - 1)))
    seg = (g % U(m)).astype(np.int64)
    g = mix(g)
    order = np.argsort(seg, kind="stable")
    seg, g = seg[order], g[order]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    total = np.add.reduceat(g, first)
    count = np.diff(np.concatenate([first, [len(g)]]))
    name = mix(seg.astype(np.uint64) + U(k << 32 | 1 << 31))
    whole = mix(total ^ name[first])
    many = np.repeat(count > 1, count)
    less = mix((np.repeat(total, count) - g) ^ name)[many]
    out = [whole, less]
    if 2 * (m - int((count > 1).sum())) > spare:
        prefix = len(s) - -(-sch.num * len(s) // sch.den) + 1
        out.append(mix(s[:prefix] ^ U(0x5BF03635)))
    return np.unique(np.concatenate(out))


class Packer:
    """Gathers entries (hash, owner) and cuts them into one blob per bucket: owners with a note each, names of 32 bits."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.nodes: list[int] = []
        self.notes: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.size = 0

    def owner(self, node: int, note: int) -> int:
        self.nodes.append(node)
        self.notes.append(note)
        return len(self.nodes) - 1

    def add(self, hashes: np.ndarray, owners: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.owners.append(owners.astype(np.uint16))
        self.size += len(hashes)

    @property
    def full(self) -> bool:
        return self.size >= FLUSH or len(self.nodes) >= 60_000

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            h, owner = np.concatenate(self.hashes), np.concatenate(self.owners)
            bucket = ((h >> U(32)) % U(self.buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            name, owner, bucket = h[order].astype(np.uint32), owner[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
            head = np.array(self.nodes, np.int64).tobytes() + np.array(self.notes, np.int64).tobytes()
            for k in range(self.buckets):
                if n := int(cuts[k + 1] - cuts[k]):
                    blob = np.array([len(self.nodes), n], np.int64).tobytes() + head + name[cuts[k] : cuts[k + 1]].tobytes() + owner[cuts[k] : cuts[k + 1]].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([blob], pa.binary())], names=["a", "blob"])
        self.clear()


def unpack(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, nodes, notes) of the entries whose names recur, sorted by name and node, without repeats."""
    names, owners, nodes, notes, at = [], [], [], [], 0
    for blob in blobs:
        raw = blob.as_buffer()
        k, n = np.frombuffer(raw, np.int64, 2).tolist()
        nodes.append(np.frombuffer(raw, np.int64, k, 16))
        notes.append(np.frombuffer(raw, np.int64, k, 16 + 8 * k))
        names.append(np.frombuffer(raw, np.uint32, n, 16 + 16 * k))
        owners.append(np.frombuffer(raw, np.uint16, n, 16 + 16 * k + 4 * n).astype(np.int32) + at)
        at += k
    name, owner, node, note = np.concatenate(names), np.concatenate(owners), np.concatenate(nodes), np.concatenate(notes)
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    some = _recurs(name)
    name, owner = name[some], owner[some]
    node, note = node[owner], note[owner]
    order = np.lexsort((node, name))
    name, node, note = name[order], node[order], note[order]
    first = np.concatenate([[True], (name[1:] != name[:-1]) | (node[1:] != node[:-1])])[: len(name)]
    name, node, note = name[first], node[first], note[first]
    some = _recurs(name)
    return name[some], node[some], note[some]


def _recurs(x: np.ndarray) -> np.ndarray:
    same = x[1:] == x[:-1]
    return (np.concatenate([[False], same]) | np.concatenate([same, [False]]))[: len(x)]


def _index(d: DataFrame, sch: Schemes, buckets: int, n: int) -> DataFrame:
    """kind 0: sig, node, cost, need of signatures that several sets have; kind 1: doc_id, key, node, n of each row."""

    def cut(rows: list[tuple[int, np.ndarray]], pack: Packer) -> None:
        sets, ks, of = [], [], []
        needs = {}
        for node, s in rows:
            for k in sch.of(len(s)):
                sets.append(s)
                ks.append(k)
                of.append(node)
        if not sets:
            return
        sig, owner, full = signatures(sets, ks, sch)
        hs = [sch.differ(k) for k in ks]
        for i, (node, k) in enumerate(zip(of, ks, strict=True)):
            needs.setdefault(node, [0, 0])[k & 1] = max(0, int(full[i]) - hs[i])
        place = {node: pack.owner(node, a | b << 32) for node, (a, b) in needs.items()}
        index = np.array([place[node] for node in of])
        pack.add(sig, index[owner])
        for i in np.flatnonzero(full <= np.array(hs)):
            near = neighbourhoods(sets[i], ks[i], sch) & ~U(3) | U(NEAR)
            pack.add(near, np.full(len(near), index[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(buckets)
        for b in batches:
            sizes, nodes = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            rows, total, seen = [], 0, set()
            for i, t in enumerate(b.column("text")):
                s = ngrams(t.as_py(), n)
                if not len(s):
                    continue
                sizes[i], nodes[i] = len(s), node_of(s)
                if (node := int(nodes[i])) not in seen:
                    seen.add(node)
                    rows.append((node, s))
                    total += len(s)
                if total >= CUT:
                    cut(rows, pack)
                    rows, total = [], 0
                    if pack.full:
                        yield from pack.flush()
                        seen.clear()
            cut(rows, pack)
            if pack.full:
                yield from pack.flush()
            info = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(nodes), pa.array(sizes)], names=["doc_id", "key", "node", "n"])
            if info.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, info.schema) as out:
                    out.write_batch(info)
                at = b.column("key")[0].as_py() % buckets
                yield pa.RecordBatch.from_arrays([pa.array([-1 - at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["a", "blob"])
            trim()
        yield from pack.flush()
        trim()

    kind = d.schema["doc_id"].dataType.simpleString()

    def gather(t: pa.Table) -> pa.Table:
        bucket = t.column("a")[0].as_py()
        if bucket < 0:
            x = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in t.column("blob")])
            cols = {"kind": np.ones(len(x), np.int32), "sig": np.zeros(len(x), np.int64), "node": x["node"], "n": x["n"], "need": np.zeros(len(x), np.int32), "doc_id": x["doc_id"], "key": x["key"]}
            return pa.table(cols)
        name, node, note = unpack(t.column("blob"))
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])[: len(name)])
        count = np.diff(np.concatenate([first, [len(name)]]))
        need = np.where(name & 1, note >> 32, note & 0xFFFFFFFF)
        need[name & 3 == NEAR] = 1
        sig = name.astype(np.int64) | bucket << 32
        out = {"kind": np.zeros(len(sig), np.int32), "sig": sig, "node": node, "n": np.repeat(count, count), "need": need.astype(np.int32), "doc_id": pa.nulls(len(sig), t.schema.field("a").type).cast(ids), "key": np.zeros(len(sig), np.int64)}
        trim()
        return pa.table(out)

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(d.schema["doc_id"].dataType)
    return d.mapInArrow(run, "a long, blob binary").groupBy("a").applyInArrow(gather, f"kind int, sig long, node long, n long, need int, doc_id {kind}, key long")


def _allocated(met: DataFrame) -> DataFrame:
    """Rows of sets that share enough subsets, with sel: whether the set looks this one up, for the cheapest suffice."""
    w = Window.partitionBy("node", F.col("sig").bitwiseAND(3))  # a set's own segments
    met = met.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy("cost", "sig")))
    return met.where("__n >= need").withColumn("sel", F.col("__r") <= F.col("__n") - F.greatest("need", F.lit(1)) + 1).drop("__n", "__r")


def _only(rows: DataFrame, wanted: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """Rows whose key is wanted (distinct keys), found without a shuffle of the rows while the keys are few enough."""
    wanted = scratch.save(wanted.select(key), name)
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, key, "left_semi")


def _sets(d: DataFrame, n: int) -> DataFrame:
    """(node, n, tokens) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                sets = [ngrams(t.as_py(), n) for t in b.column(0).slice(lo, 100)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "tokens"])
            trim()

    return d.select("text").mapInArrow(run, "node long, n long, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, sch: Schemes) -> DataFrame:
    """Those of pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [sch.linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            trim()

    low, high = sch.num, sch.den
    s = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    p = pairs.join(s("b"), "b").join(s("a"), "a").where((F.col("na") * high >= F.col("nb") * low) & (F.col("nb") * high >= F.col("na") * low))
    return p.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _unlike(met: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of the buckets that hold several components and that one of its sets looks up, allocated anew."""
    lo = met.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("cost"), F.max("sel").alias("any"))
    lo = scratch.save(lo.where("lo <> hi").select("sig", "cost"), f"{name}-buckets")
    out = scratch.save(_allocated(met.drop("cost", "sel").join(lo, "sig")), name)
    scratch.drop(f"{name}-buckets")
    return out


def _supported(docs: DataFrame, sch: Schemes, buckets: int) -> DataFrame:
    """Nodes of docs (node, root, tokens, n) that may have a partner: enough of their tokens are in other components' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(buckets)
        for b in batches:
            for node, root, tokens in zip(b.column("node").to_pylist(), b.column("root").to_pylist(), b.column("tokens"), strict=True):
                t = mix(np.frombuffer(tokens.as_buffer(), np.uint64))
                pack.add(t, np.full(len(t), pack.owner(node, root)))
                if pack.full:
                    yield from pack.flush()
        yield from pack.flush()
        trim()

    def gather(t: pa.Table) -> pa.Table:
        name, node, root = unpack(t.column("blob"))
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])[: len(name)])
        lo, hi = (f.reduceat(root, first) if len(first) else root for f in (np.minimum, np.maximum))
        node = node[np.repeat(lo != hi, np.diff(np.concatenate([first, [len(name)]])))]
        node, count = np.unique(node, return_counts=True)
        trim()
        return pa.table({"node": node, "c": count})

    found = docs.select("node", "root", "tokens").mapInArrow(run, "a long, blob binary").groupBy("a").applyInArrow(gather, "node long, c long")
    return found.groupBy("node").agg(F.sum("c").alias("c")).join(docs.select("node", "n"), "node").where(F.col("c") * sch.den >= F.col("n") * sch.num).select("node")


def _compared(docs: DataFrame, sch: Schemes, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components in the clusters of docs (node, root, cluster, n, tokens)."""
    # A component with many sets in a cluster has chunks of its own.
    per = docs.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    per = per.withColumn("own", F.when(F.col("c") >= CHUNK_SETS, F.col("root")))
    parts = per.groupBy("cluster", "own").agg(F.greatest(F.ceil(F.sum("c") / CHUNK_SETS), F.ceil(F.sum("t") / CHUNK_TOKENS)).cast("long").alias("k"))
    w = Window.partitionBy("cluster")  # a row for each chunked component
    parts = parts.withColumn("base", F.coalesce(F.sum("k").over(w.orderBy("own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("k").over(w))
    per = per.join(parts.select(F.col("cluster").alias("__c"), F.col("own").alias("__o"), "k", "base", "all"), (F.col("cluster") == F.col("__c")) & F.col("own").eqNullSafe(F.col("__o")))
    per = scratch.save(per.select("cluster", "root", "own", "k", "base", "all"), "ngram-chunks")
    x = docs.join(per, ["cluster", "root"]).withColumn("x", F.col("base") + F.pmod(F.xxhash64("node"), F.col("k")))
    x = x.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)))
    x = x.where(F.col("own").isNull() | (F.col("y") < F.col("base")) | (F.col("y") >= F.col("base") + F.col("k")))
    x = x.select("cluster", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).alias("right"), "node", "root", "tokens")
    num, den = sch.num, sch.den

    def run(t: pa.Table) -> pa.Table:
        node, root, right = (t.column(c).to_numpy() for c in ("node", "root", "right"))
        one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
        size = np.array([len(s) for s in sets])
        left = np.flatnonzero(~right)
        other = left if one else np.flatnonzero(right)
        edges: list[tuple[int, int]] = []
        if len(left) and len(other):
            token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = np.cumsum(count > 1) - 1  # tokens of one set don't matter
            owner = np.repeat(np.arange(len(sets)), size)
            some = (count > 1)[inverse]
            owner, at = owner[some], shared[inverse[some]]
            common = np.zeros((len(left), len(other)), np.float32)
            order = np.argsort(at, kind="stable")
            owner, at = owner[order], at[order]
            step = max(256, 2_000_000 // len(sets))
            for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
                i, j = np.searchsorted(at, [lo, lo + step])
                m = np.zeros((len(sets), step), np.float32)
                m[owner[i:j], at[i:j] - lo] = 1
                common += m[left] @ m[other].T
            both = size[left][:, None] + size[other][None, :] - common
            ok = (den * common.astype(np.float64) >= num * both) & (root[left][:, None] != root[other][None, :])
            up: dict[int, int] = {}

            def find(r: int) -> int:
                while (y := up.get(r, r)) != r:
                    r = y
                return r

            for a, b in zip(*np.nonzero(ok), strict=True):
                a, b = left[a], other[b]
                x, y = find(int(root[a])), find(int(root[b]))
                if x != y:
                    up[x] = y
                    edges.append((int(node[a]), int(node[b])))
        trim()
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return x.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def members(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, key (a hash of id and text), n_shingles, component_id (the smallest id of the documents reachable by links) and
    root (the component's own name; null without n-grams)."""
    spark = docs.sparkSession
    sch = Schemes(num, den)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("key"))
    buckets = min(65_000, max(24, docs.count() // GATHER))
    scratch.save(_index(d, sch, buckets, n), "ngram-index", by="kind")
    index = scratch.get("ngram-index")
    info = index.where("kind = 1").select("doc_id", "key", "node", F.col("n").alias("n_shingles"))
    nodes = scratch.save(info.where("n_shingles > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "ngram-nodes")

    met = scratch.save(_allocated(index.where("kind = 0").select("sig", "node", F.col("n").alias("cost"), "need")), "ngram-met")
    first = met.groupBy("sig").agg(F.min("node").alias("first"), F.count("*").alias("c"), F.max("sel").alias("any")).where("c > 1 and any").select("sig", "first")
    met = scratch.save(met.join(scratch.save(first, "ngram-first"), "sig"), "ngram-shared")
    best = met.where("node <> first").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("times"))
    best = scratch.save(best.groupBy("b").agg(F.max_by("a", F.struct("times", F.negative("a"))).alias("a")).select("a", "b"), "ngram-best")
    scratch.drop("ngram-met", "ngram-first")

    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi")
    sets = scratch.save(_sets(_only(d, wanted, "key", scratch, "ngram-wanted"), n).dropDuplicates(["node"]), "ngram-sets")
    links = scratch.save(_verified(best, sets, sch), "ngram-links")
    comp = scratch.save(components(links), "ngram-stars")

    met = met.drop("first").join(comp.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = _unlike(scratch.save(met, "ngram-rooted"), scratch, "ngram-left")
    scratch.drop("ngram-shared", "ngram-rooted", "ngram-best", "ngram-wanted")
    left = scratch.save(met.select("node", "root").distinct().join(sets, "node"), "ngram-support")
    good = scratch.save(_supported(left, sch, max(24, left.count() // GATHER)), "ngram-good")
    met = _unlike(met.join(good, "node", "left_semi"), scratch, "ngram-rest")

    # What is left is compared by cluster: sets that share a bucket which one of them looks up.
    first = met.groupBy("sig").agg(F.min("node").alias("first"), F.max("sel").alias("any")).where("any").select("sig", "first")
    edges = met.join(scratch.save(first, "ngram-first"), "sig").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    clusters = scratch.save(components(edges).withColumnRenamed("root", "cluster"), "ngram-clusters")
    more = scratch.save(_compared(clusters.join(left, "node"), sch, scratch), "ngram-more")
    comp = comp if more.isEmpty() else components(more.unionByName(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")))

    of = nodes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = scratch.save(of.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("c")).where("c > 1").drop("c"), "ngram-least")
    of = scratch.save(of.join(least, "root").select("node", "root", "component_id"), "ngram-component")
    info = scratch.save(info, "ngram-info")
    scratch.keep("ngram-info", "ngram-component")
    linked = info.where("n_shingles > 0").join(of.withColumnRenamed("component_id", "least"), "node", "left")
    alone = F.col("root").isNull()
    linked = linked.select("doc_id", "key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "node").alias("root"))
    return linked.unionByName(info.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def link(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return members(docs, Scratch(docs.sparkSession), **parameters).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """Those rows of docs, all columns, that stand for their component: the smallest id (null last), one row if it recurs.

    Rows without n-grams all stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    m = members(docs, scratch, doc_id=doc_id, text=text, **parameters)
    rows = m.where("n_shingles > 0").groupBy("root", "key").agg(F.min("doc_id").alias("id"), F.count("*").alias("c"))
    lead = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "c")).alias("x")).select(F.col("x.key").alias("key"), F.col("x.c").alias("c"))
    none = m.where("n_shingles = 0").select("key").distinct()
    keep = scratch.save(lead.select("key", (F.col("c") > 1).alias("again")).unionByName(none.withColumn("again", F.lit(False))), "ngram-keep")
    size, again = keep.agg(F.count("*"), F.coalesce(F.max("again"), F.lit(False))).first()
    k = keep.select(F.col("key").alias("__key"), "again")
    d = docs.withColumn("__key", F.xxhash64(doc_id, text))
    pick = lambda k: d.join(F.broadcast(k) if size <= BROADCAST_ROWS else k, "__key", "left_semi")
    if not again:
        return pick(k).select(*docs.columns)
    return pick(k.where("not again")).unionByName(pick(k.where("again")).dropDuplicates(["__key"])).select(*docs.columns)
