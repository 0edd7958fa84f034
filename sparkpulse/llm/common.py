"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below the session's checkpoint folder, which all executors share.

    Where spark.checkpoint.dir is unset, a local master (tests) gets a folder of its own; a cluster has to set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = os.environ.get("SPARKPULSE_CHECKPOINT_DIR")
        if not base and not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = base or os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sparkpulse/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: a lost executor costs no recomputation beyond this point."""
    return Scratch(df.sparkSession).save(df, name)


class Scratch:
    """Tables that an operator has written to the shared folder, by name; the ones that are done with are deleted early."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}
        self.frames: dict[str, DataFrame] = {}

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = shared_dir(self.spark, name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        self.drop(name)
        self.paths[name] = path
        self.frames[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.frames[name]

    def get(self, name: str) -> DataFrame:
        return self.frames[name]

    def drop(self, *names: str) -> None:
        for name in names:
            self.frames.pop(name, None)
            if path := self.paths.pop(name, None):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, *names: str) -> None:
        self.drop(*(set(self.paths) - set(names)))


def trim() -> None:
    """Give memory that this Python worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
