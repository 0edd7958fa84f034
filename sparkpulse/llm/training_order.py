"""Training-order materialisation: token sequences at keyed pseudorandom slots, in shards of fixed-stride records.

Token streams are columns of fixed-width little-endian ids (``ids`` and ``width``), or, without one, the texts' UTF-8 bytes, a byte a
token.  Each document's tokens end with ``end``, an id outside the vocabulary (0xFF, which UTF-8 never has, for bytes); documents
are packed end to end into sequences of ``length`` tokens and the last one is padded with ``pad``.  Sequence i gets slot
``permute(i)``, a Feistel permutation with cycle-walking keyed by ``key``; another key gives another epoch.  Shard s holds slots
[s * per_shard, (s + 1) * per_shard) in order, so record r of the order lies at byte ``(r % per_shard) * stride`` of
shard ``r // per_shard``: reading is sequential and resumes at any slot with one seek.

Documents stand in the order of a hash of their id and tokens, so the order doesn't depend on how the rows are split.  A record is a
header (slot, sequence as unsigned 64-bit, number of tokens as unsigned 32-bit, CRC-32 of the payload; little-endian) and
``length`` tokens.  Each task writes a range of shards, under temporary names and renamed, so a repeated or speculative task
leaves one whole file.  Null texts are empty: an end token alone.  Empty tables give no shards and no rows.  Rows with equal ids are
separate documents, equal rows too.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_dir
from .feistel import permute
from .spans import blocks_of, with_offsets

HEADER = "<QQII"
HEADER_SIZE = struct.calcsize(HEADER)
#: For byte tokens: values that UTF-8 never has.
END, PAD = 0xFF, 0xFE
#: Documents whose places are sent to every executor at most; beyond, texts are shuffled to them.
BROADCAST_ROWS = 1_000_000


def streams(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ids: str | None = None, width: int = 1, end: int = END) -> DataFrame:
    """key, doc_id, bytes (the document's tokens and the end token) and n (tokens)."""
    body = F.coalesce(F.col(ids), F.lit(b"")) if ids else F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    d = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    return d.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "body").alias("key"), "doc_id", F.concat("body", F.lit(end.to_bytes(width, "little"))).alias("bytes"), ((F.octet_length("body") / width).cast("long") + 1).alias("n"))


def sequences(d: DataFrame, scratch: Scratch, *, length: int, width: int = 1) -> tuple[DataFrame, int]:
    """Pieces (sequence, at, doc_id, bytes): what each document of streams puts into which sequence, from which token of it on; and
    the number of tokens."""
    rows = scratch.save(d.groupBy("key").agg(F.first("n").alias("n"), F.count("*").alias("copies")), "order-rows")
    total, size, most = rows.agg(F.coalesce(F.sum(F.col("n") * F.col("copies")), F.lit(0)), F.count("*"), F.coalesce(F.max("copies"), F.lit(1))).first()
    rows = with_offsets(rows.withColumn("all", F.col("n") * F.col("copies")), "all", by=[], order=["key"]).select("key", F.col("offset").cast("long").alias("offset"), "copies")
    rows = scratch.save(rows, "order-offsets")
    place = lambda r: F.broadcast(r) if size <= BROADCAST_ROWS else r
    if most > 1:  # of equal rows one stands for all
        again = rows.where("copies > 1")
        d = d.join(place(rows.where("copies = 1")), "key").unionByName(d.join(place(again), "key").dropDuplicates(["key"]))
        d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("offset", F.col("offset") + F.col("copy") * F.col("n"))
    else:
        d = d.join(place(rows), "key")
    d = d.withColumn("sequence", F.explode(blocks_of(F.col("offset"), F.col("n"), length)))
    a = F.greatest(F.col("offset"), F.col("sequence") * length)
    b = F.least(F.col("offset") + F.col("n"), (F.col("sequence") + 1) * length)
    cut = F.substring("bytes", ((a - F.col("offset")) * width + 1).cast("int"), ((b - a) * width).cast("int"))
    return d.select("sequence", (a - F.col("sequence") * length).cast("int").alias("at"), "doc_id", cut.alias("bytes")), total


def write(docs: DataFrame, path: str, *, key: str, length: int = 2048, per_shard: int = 4096, width: int = 1, pad: int = PAD, **columns) -> DataFrame:
    """Write the shards below ``path`` (a URI that pyarrow opens) and return the manifest: shard, file, records."""
    pieces, total = sequences(streams(docs, width=width, **columns), Scratch(docs.sparkSession), length=length, width=width)
    n = -(-total // length)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = permute(b.column("sequence").to_numpy(zero_copy_only=False), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard, pa.int64()), pa.array(slot, pa.int64()), *(b.column(c) for c in ("sequence", "at", "bytes"))], names=["shard", "slot", "sequence", "at", "bytes"])

    filler = pad.to_bytes(width, "little")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        now, sink, temp, records, slot, seq, buf = None, None, "", 0, None, 0, b""
        done: list[tuple[int, str, int]] = []

        def flush() -> None:
            nonlocal records
            if slot is not None:
                sink.write((struct.pack(HEADER, slot, seq, len(buf) // width, zlib.crc32(buf)) + buf + filler * (length - len(buf) // width)))
                records += 1

        def close() -> None:
            if sink is not None:
                flush()
                sink.close()
                name = f"{root}/shard-{now:08d}.bin"
                store.move(temp, name)
                done.append((now, name, records))

        for b in batches:
            for shard, s, q, piece in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "sequence", "bytes")), strict=True):
                if s != slot:
                    if shard != now:
                        close()
                        store.create_dir(root, recursive=True)
                        temp = f"{root}/_writing-{shard:08d}-{uuid.uuid4().hex}"
                        now, sink, records, slot = shard, store.open_output_stream(temp), 0, None
                    flush()
                    slot, seq, buf = s, q, b""
                buf += piece
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["shard", "file", "records"])

    # Range partitions: the range of each task is known beforehand, for slots are dense.
    count = max(1, -(-n // per_shard))
    tasks = min(count, 100_000)
    pieces = pieces.mapInArrow(slots, "shard long, slot long, sequence long, at int, bytes binary")
    return pieces.repartitionById(tasks, F.floor(F.col("shard") * tasks / count).cast("int")).sortWithinPartitions("slot", "at").mapInArrow(shards, "shard long, file string, records long")


def read(spark: SparkSession, path: str, *, length: int = 2048, width: int = 1, per_shard: int = 4096, start: int = 0) -> DataFrame:
    """Records in slot order within shards, from slot ``start`` on: slot, sequence, file, offset, n_tokens, crc32, intact, tokens.

    Shards before it aren't opened; in its own one reading begins with a seek."""
    stride, many = HEADER_SIZE + length * width, 512
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for shard, name in zip(b.column("shard").to_pylist(), b.column("path").to_pylist(), strict=True):
                store, file = fs.FileSystem.from_uri(name)
                at = max(0, start - shard * per_shard) * stride
                with store.open_input_file(file) as f:
                    f.seek(min(at, f.size()))
                    while data := f.read(many * stride):
                        rows = []
                        for i in range(0, len(data), stride):
                            slot, seq, n, crc = struct.unpack(HEADER, data[i : i + HEADER_SIZE])
                            tokens = data[i + HEADER_SIZE : i + HEADER_SIZE + n * width]
                            rows.append((slot, seq, name, at + i, n, crc, zlib.crc32(tokens) == crc, tokens))
                        at += len(data)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["slot", "sequence", "file", "offset", "n_tokens", "crc32", "intact", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path).select("path", F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("shard"))
    return files.where(F.col("shard") >= start // per_shard).mapInArrow(parse, "slot long, sequence long, file string, offset long, n_tokens long, crc32 long, intact boolean, tokens binary")


def order(docs: DataFrame, *, key: str = "epoch-0", length: int = 2048, per_shard: int = 4096) -> DataFrame:
    """Write all of docs' sequences, then read them back: one row per sequence."""
    spark = docs.sparkSession
    path = shared_dir(spark, "order")
    schema = "slot long, sequence long, shard long, offset long, n_tokens long, crc32 long, tokens_sha256 string, intact boolean"
    manifest = write(docs, path, key=key, length=length, per_shard=per_shard)
    if manifest.agg(F.count("*")).first()[0] == 0:
        return spark.createDataFrame([], schema)
    return read(spark, path, length=length, per_shard=per_shard).select("slot", "sequence", F.floor(F.col("slot") / per_shard).alias("shard"), "offset", "n_tokens", "crc32", F.sha2("tokens", 256).alias("tokens_sha256"), "intact")
