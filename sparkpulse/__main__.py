"""Command line: ``python -m sparkpulse COMMAND chat.tsv out`` writes a table in CSV (a script as text).

Commands: histogram, sliding, peaks, regions, clips, script.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpulse.api import Analyzer
from sparkpulse.sources import sinks

COMMANDS = ("histogram", "sliding", "peaks", "regions", "clips", "script")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sparkpulse")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("chat", help="chat log (TSV), one or many files")
    p.add_argument("out")
    p.add_argument("--step", type=int, default=10)
    p.add_argument("--window", type=int, default=60)
    p.add_argument("--degree", type=int, default=3, help="trend; 0 leaves the signal as it is")
    p.add_argument("--prominence", type=float, default=10.0)
    p.add_argument("--start", type=float)
    p.add_argument("--end", type=float)
    p.add_argument("--before", type=float, default=10.0)
    p.add_argument("--after", type=float, default=10.0)
    p.add_argument("--z", type=float, default=0.0)
    p.add_argument("--video", default="in.mp4")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    a = Analyzer.from_tsv(spark, args.chat, step=args.step, window=args.window, degree=args.degree)
    if args.command == "histogram":
        return a.histogram_table()
    if args.command == "sliding":
        return a.sliding_table(args.start, args.end)
    if args.command == "peaks":
        return a.peaks_table(args.prominence, args.start, args.end)
    if args.command == "regions":
        return a.regions_table(args.z, args.start, args.end)
    if args.command == "clips":
        return a.clips_table(args.prominence, args.before, args.after)
    return a.script(args.prominence, args.before, args.after, args.video)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, args)
    if args.command == "script":
        sinks.script(out, args.out)
    else:
        sinks.table_csv(out.orderBy("stream_id", F.col(out.columns[1])), args.out)


if __name__ == "__main__":
    main()
