"""Mixing sources to target weights in blocks of a fixed number of words.

Sources in code-point order (null last) weigh 1, 2, 3, repeating.  A source's target is its weight's share of all words,
at most ``most`` times its size; what that leaves over is shared out again by weight.  Each source's words, documents end
to end, are cut into blocks.  For each output shard the number of slots of each source is drawn from a multinomial.  Draws
beyond a source's quota (its target in blocks) are released and sources short of theirs take them, so totals meet the
targets.  A source's slots run through its blocks in passes; slot j is block ``permute(j mod blocks)`` under a key of the
source and the pass, so each pass takes every block once before any is taken again, and no word more than ``most`` times.

Null texts have no words and null sources form one source.  An empty table gives no rows.  Rows that repeat an id are
documents of their own; equal rows are interchangeable.  A source without words has target 0.  Extra columns are ignored, or
kept by ``mixed_documents``, whatever their names.  Equal seeds give equal mixes, however the rows are split or ordered: documents
are named by a hash of their id, source and text, not by row numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .feistel import permute, seeds
from .quality import bind, words
from .spans import blocks_of, with_offsets

BLOCK, SHARD = 256, 4096
#: Sources whose shares are drawn at once.
MOST_SOURCES = 500_000


def targets(sizes: DataFrame, *, most: int = 3) -> DataFrame:
    """sizes (source, source_size) with weight, target and number, the source's place in order."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("number", F.row_number().over(every).cast("long")).withColumn("weight", ((F.col("number") - 1) % 3 + 1).cast("double"))
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.col("source_size") * most
    left = F.sum("source_size").over(total) - F.coalesce(F.sum(full).over(before), F.lit(0))
    share = left / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("__share", share).withColumn("__full", full <= F.col("weight") * F.col("__share"))
    level = F.min(F.when(~F.col("__full"), F.struct(F.col("source_size") / F.col("weight"), F.col("number"), F.col("__share").alias("share")))).over(total)
    return s.withColumn("target", F.when(F.col("__full"), full.cast("double")).otherwise(F.col("weight") * level["share"])).drop("__share", "__full")


def row_key(doc_id: str, source: str, text: str):
    """A hash of a row, nulls told apart."""
    return F.xxhash64(*(x for c in (doc_id, source, text) for x in (F.col(c).isNull(), F.col(c))))


def plan(docs: DataFrame, scratch: Scratch, *, seed: str = "mix-0", doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): key, doc_id, copies (equal rows), size, source_size, target per document; key, copy, at, words, times
    per piece in a taken block."""
    spark = docs.sparkSession
    d = docs.select(row_key(doc_id, source, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"))
    d = scratch.save(d, "mix-rows")  # texts are read once
    d = scratch.save(d.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "size")), F.count("*").alias("copies")), "mix-documents")
    d = d.withColumn("all", F.col("size") * F.col("copies"))
    s = targets(d.groupBy("source").agg(F.sum("all").alias("source_size")), most=most)
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("quota", F.when(F.col("blocks") > 0, F.least(F.col("blocks") * most, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0).cast("long"))
    rows = s.orderBy("number").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    quota = np.array([r.quota for r in rows], np.int64)
    blocks = np.array([r.blocks for r in rows], np.int64)
    total = int(quota.sum())
    share = quota / max(1, total)
    shards = -(-total // shard)
    s = spark.createDataFrame([(r.source, r.number, r.source_size, float(r.target)) for r in rows], f"source {dict(s.dtypes)['source']}, number long, source_size long, target double")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                rng = np.random.default_rng([*seed.encode(), k])
                n = rng.multinomial(min(shard, total - k * shard), share)
                out += [(k, i + 1, int(n[i])) for i in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["shard", "number", "n"])

    drawn = spark.range(shards).mapInArrow(draw, "shard long, number long, n long")
    # Draws beyond the quota are released; what is short comes in a last shard.
    short = drawn.groupBy("number").agg(F.sum("n").alias("have"))
    wanted = spark.createDataFrame([(int(i + 1), int(q)) for i, q in enumerate(quota)], "number long, quota long")
    extra = wanted.join(short, "number", "left").select(F.lit(shards).cast("long").alias("shard"), "number", (F.col("quota") - F.coalesce("have", F.lit(0))).alias("n")).where("n > 0")
    runs = with_offsets(drawn.unionByName(extra), "n", by=["number"], order=["shard"], out="first").join(wanted, "number")
    runs = runs.select("number", "shard", "first", F.least(F.col("n"), F.col("quota") - F.col("first")).alias("n")).where("n > 0")
    slots = runs.select("number", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, slot = (b.column(c).to_numpy(zero_copy_only=False) for c in ("number", "slot"))
            size = blocks[number - 1]
            out = permute(slot % size, size, seeds(seed, number, slot // size))
            yield pa.RecordBatch.from_arrays([b.column("number"), b.column("shard"), b.column("slot"), pa.array(out)], names=["number", "shard", "slot", "block"])

    taken = slots.mapInArrow(to_blocks, "number long, shard long, slot long, block long").groupBy("number", "block").agg(F.count("*").alias("times"))
    d = d.withColumn("__key", F.coalesce(F.col("source").cast("string"), F.lit("\0null")))
    numbers = s.withColumn("__key", F.coalesce(F.col("source").cast("string"), F.lit("\0null"))).drop("source")
    d = with_offsets(d.join(F.broadcast(numbers), "__key"), "all", by=["number"], order=["key"]).drop("__key")  # at most MOST_SOURCES rows
    parts = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("offset") + F.col("copy") * F.col("size"))
    parts = parts.withColumn("block", F.explode(blocks_of(F.col("start"), F.col("size"), block)))
    a = F.greatest(F.col("start"), F.col("block") * block)
    b = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = parts.select("key", "copy", "number", "block", (a - F.col("start")).alias("at"), (b - a).alias("words")).join(taken, ["number", "block"])
    return d, pieces.select("key", "copy", "at", "words", "times")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    scratch = Scratch(docs.sparkSession)
    d, pieces = plan(docs, scratch, **parameters)
    taken = pieces.groupBy("key", "copy").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return d.join(taken, ["key", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """The mix as rows with docs' columns: copy c of a document holds its words in blocks taken c times or more.

    A document that the mix doesn't take is absent, one taken whole keeps its text as it is; partly taken ones keep the taken
    words, joined by one blank.
    """
    scratch = Scratch(docs.sparkSession)
    rows, pieces = plan(docs, scratch, doc_id=doc_id, text=text, source=source, **parameters)
    p = pieces.groupBy("key", "copy").agg(F.sort_array(F.collect_list(F.struct("at", "words", "times"))).alias("__pieces"))  # a document's own blocks
    p = scratch.save(p.withColumnRenamed("key", "__key").withColumnRenamed("copy", "__row"), "mix-pieces")
    again = scratch.save(rows.where("copies > 1").select(F.col("key").alias("__key")), "mix-again")
    scratch.keep("mix-pieces", "mix-again")
    d = docs.withColumn("__key", row_key(doc_id, source, text))
    if again.isEmpty():
        d = d.join(p, "__key")
    else:  # of equal rows one takes the pieces of all
        several = d.join(again, "__key", "left_semi").dropDuplicates(["__key"])
        d = d.join(p.join(again, "__key", "left_anti"), "__key").unionByName(several.join(p, "__key"))
    d = d.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("__pieces", lambda x: x["times"])))))
    d = d.withColumn("__own", F.filter("__pieces", lambda x: x["times"] >= F.col("__copy")))
    got = F.aggregate("__own", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    some = lambda ws: F.array_join(F.transform("__own", lambda x: F.array_join(F.slice(ws, (x["at"] + 1).cast("int"), x["words"].cast("int")), " ")), " ")
    picked = bind(words(F.col(text)), lambda ws: F.when(got == F.size(ws), F.col(text)).otherwise(some(ws)))
    return d.withColumn(text, picked).select(*docs.columns)
