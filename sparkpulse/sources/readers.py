"""Sources: chat logs (TSV), live-chat JSON lines, subtitles, WAV audio, and adapters of event tables."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpulse.functions.timefmt import parse_time, srt_time

LIVE = "replayChatItemAction struct<actions: array<struct<addChatItemAction: struct<item: struct<liveChatTextMessageRenderer: struct<timestampText: struct<simpleText: string>, authorName: struct<simpleText: string>, message: struct<runs: array<struct<text: string, emoji: struct<shortcuts: array<string>>>>>>>>>>>"
EPOCH = 1704067200


def stream_of(path: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(path), r"\.[^.]*$", "")


def chat_tsv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Messages of tab-separated logs with a header; one stream per file.  Rows without a valid time fail, or are dropped."""
    df = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = {"video_time", "author", "message"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    df = df.select(stream_of().alias("stream_id"), F.monotonically_increasing_id().alias("row_id"), *df.columns)
    df = df.withColumn("seconds", parse_time("video_time", strict))
    return df if strict else df.where("seconds is not null")


def live_chat(spark: SparkSession, path: str) -> DataFrame:
    """Text messages of live-chat JSON lines; unreadable lines, other items, empty and negative times are left out."""
    raw = spark.read.text(path).select(stream_of().alias("stream_id"), F.monotonically_increasing_id().alias("line"), F.from_json("value", LIVE).alias("j"))
    items = raw.select("stream_id", "line", F.posexplode("j.replayChatItemAction.actions").alias("pos", "a")).select("stream_id", "line", "pos", F.col("a.addChatItemAction.item.liveChatTextMessageRenderer").alias("m"))
    at = F.col("m.timestampText.simpleText")
    runs = F.transform("m.message.runs", lambda r: F.coalesce(r["text"], F.get(r["emoji"]["shortcuts"], F.lit(0)), F.lit("")))
    text = F.trim(F.array_join(F.filter(F.coalesce(runs, F.array()), lambda x: x != ""), " "))
    m = items.where(F.col("m").isNotNull() & (F.coalesce(at, F.lit("")) != "") & ~at.startswith("-"))
    return m.select("stream_id", (F.col("line") * 1000 + F.col("pos")).alias("row_id"), at.alias("video_time"), F.coalesce("m.authorName.simpleText", F.lit("Unknown")).alias("author"), text.alias("message"), parse_time(at).alias("seconds"))


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT or loose VTT files, one stream per file: idx, start, end, text; malformed blocks are skipped."""
    whole = spark.read.text(path, wholetext=True).select(stream_of().alias("stream_id"), F.regexp_replace("value", r"\r\n?", "\n").alias("v"))
    # One blank line may stand between a timecode and its text.
    joined = F.regexp_replace("v", r"(?m)^([^\n]*-->[^\n]*)\n[ \t]*\n(?=[^\n]*\S)(?![^\n]*-->)(?!\d+\n[^\n]*-->)", "$1\n")
    blocks = whole.select("stream_id", F.posexplode(F.split(joined, r"\n[ \t]*\n+")).alias("pos", "b"))
    time = r"(?s)^\s*(?:(\d+)[ \t]*\n)?\s*([\d:.,]+)\s*-->\s*([\d:.,]+)[^\n]*(?:\n(.*))?$"
    part = lambda i: F.regexp_extract("b", time, i)
    cues = blocks.where(F.col("b").rlike(time)).select("stream_id", "pos", F.coalesce(part(1).try_cast("int"), F.lit(0)).alias("idx"), srt_time(part(2)).alias("start"), srt_time(part(3)).alias("end"), F.trim(part(4)).alias("text"))
    return cues.where("start is not null and end is not null")


def wav_frames(spark: SparkSession, path: str, frame_ms: int = 30, hop_ms: int = 10) -> DataFrame:
    """RMS energy of overlapping frames of mono or mixed-down WAV files: stream_id, frame, rms."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["stream_id"], b["content"], strict=True):
                with wave.open(io.BytesIO(data)) as w:
                    kind = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}[w.getsampwidth()]
                    x = (np.frombuffer(w.readframes(w.getnframes()), kind[0]).astype("f8") - kind[1]) / kind[2]
                    x, rate = x.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
                size, hop = rate * frame_ms // 1000, rate * hop_ms // 1000
                if len(x) >= size > 0:
                    total = np.concatenate([[0.0], np.cumsum(x * x)])
                    at = np.arange((len(x) - size) // hop + 1) * hop
                    yield pd.DataFrame({"stream_id": name, "frame": np.arange(len(at)), "rms": np.sqrt(np.maximum(0, total[at + size] - total[at]) / size)})

    files = spark.read.format("binaryFile").load(path).select(stream_of().alias("stream_id"), "content")
    return files.mapInPandas(run, "stream_id string, frame long, rms double")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as messages; each event type is a stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sec = F.floor(F.col("ts").cast("timestamp").cast("double")).cast("bigint") - EPOCH
    return e.select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("row_id"), F.col("user_id").cast("string").alias("author"), F.concat_ws(" ", "event_type", "props").alias("message"), sec.alias("seconds"), F.col("value"))


#: Result tables that are read back, by kind.
ARTEFACTS = {
    "frequency": "time_seconds double, time_hms string, normalized_frequency double",
    "regions": "region_index int, start_seconds double, end_seconds double, start_hms string, end_hms string, duration_seconds double, z_threshold double",
    "alignment": "highlight_file string, segment_idx int, highlight_start_s double, highlight_end_s double, stream_start_s double, stream_end_s double, duration_s double, mean_ncc double, n_windows int, method string, highlight_start_hms string, highlight_end_hms string, stream_start_hms string, stream_end_hms string",
    "metrics": "metric string, value string, note string",
}


def artefact(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A result table in CSV with a header, by its fixed schema; stream_id is the file's name up to its last underscore."""
    df = spark.read.schema(ARTEFACTS[kind]).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(F.regexp_replace(stream_of(), r"_[^_]*$", "").alias("stream_id"), *df.columns)


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """label and value (path) of the video files right in a folder, by label regardless of case."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("value"), F.element_at(F.split("path", "/"), -1).alias("label"))
    return files.where(F.lower("label").rlike(r"\.(mp4|mkv|avi|mov|webm|flv|wmv|m4v|mpg|mpeg)$")).select("label", "value").orderBy(F.lower("label"))


def subtitle_for(spark: SparkSession, path: str) -> DataFrame:
    """stem and path of each basename's subtitle in a folder: SRT before VTT."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return files.where(kind.isin("srt", "vtt")).groupBy(F.regexp_replace("name", r"\.[^.]*$", "").alias("stem")).agg(F.min_by("path", F.struct(kind, "path")).alias("path"))


def silence_cache(spark: SparkSession, path: str, params: dict) -> DataFrame:
    """start and end of the intervals in silence caches of version 1 with exactly these parameters (others are out of date)."""
    fields = "version int, params struct<frame_ms: int, hop_ms: int, threshold_db: double, min_silence_ms: int>, intervals array<array<double>>"
    j = spark.read.schema(fields).option("multiLine", True).json(path).select(stream_of().alias("stream_id"), "*").where("version = 1")
    for name in ("frame_ms", "hop_ms", "threshold_db", "min_silence_ms"):
        j = j.where(F.col(f"params.{name}") == params[name])
    return j.select("stream_id", F.explode("intervals").alias("i")).select("stream_id", F.get("i", F.lit(0)).alias("start"), F.get("i", F.lit(1)).alias("end"))
