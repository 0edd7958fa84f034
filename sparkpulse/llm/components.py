"""Connected components of very large graphs: alternating large-star and small-star steps (Kiveris et al.), in joins.

Before each pair of steps every task contracts its own edges to stars (union-find over at most CHUNK children at a time), so
that few steps are left, and none if one task held all edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that a task contracts together: a bound of a worker's memory.
CHUNK = 100_000


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Stars (u, v) that connect what edges (u, v) connect, as each task sees it."""

    def stars(up: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([_find(up, x) for x in up], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = _find(up, u), _find(up, v)
                if x != y:
                    up[max(x, y)] = min(x, y)
                if len(up) > CHUNK:
                    yield stars(up)
                    up = {}
        yield stars(up)

    return edges.select("u", "v").coalesce(tasks).mapInArrow(run, "u long, v long")


def _find(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = x = up.get(y, y)
    return x


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that it reaches.  Self-loops are dropped."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        e = materialise(e, name)
        tasks = max(1, math.ceil(e.count() / CHUNK))
        e = materialise(_contracted(e, tasks), name)
        # Done when all are stars: each child has one parent, and no parent is a child.  A task's own edges are.
        if tasks == 1:
            break
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        ends = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if ends.where((F.col("child") > 1) | (F.col("child") > 0) & (F.col("parent") > 0)).isEmpty():
            break
        # Large star: larger neighbours of a node go to the smallest of it and its neighbours.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
