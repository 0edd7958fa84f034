"""Running totals over very many rows without one task per group, and pieces of rows on a grid of fixed-length blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window of a running total holds, about.
ROWS = 4000


def with_offsets(df: DataFrame, size: str, *, by: list[str], order: list[str], out: str = "offset") -> DataFrame:
    """df and ``out``: the sum of ``size`` over the rows of the same ``by`` that stand before it.

    Rows are dealt to buckets by a hash of ``order``; the totals of buckets are summed up first, then the rows of each
    bucket.  No task holds more than a bucket of a group, so a group with any share of the rows is spread.  Ties are
    broken by ``size``; rows equal in both are interchangeable.  Nulls in ``by`` form a group of their own.
    """
    n = max(16, df.count() // ROWS)
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    df = df.select("*", *keys)
    totals = df.groupBy(*names, "__bucket").agg(F.sum(size).alias("__total"))
    before = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*names, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*names, "__bucket").orderBy(*order, size).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inner", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return df.join(totals, [*names, "__bucket"], "left").withColumn(out, F.col("__before") + F.col("__inner")).drop("__bucket", "__before", "__inner", *names)


def blocks_of(offset: Column, size: Column, length: int) -> Column:
    """The numbers of the blocks of ``length`` that [offset, offset + size) touches; an empty array for size 0."""
    n = F.lit(length)
    return F.when(size > 0, F.sequence(F.floor(offset / n), F.floor((offset + size - 1) / n))).otherwise(F.array().cast("array<bigint>"))
