"""The helpers as SQL functions of a session: parse_time, seconds_to_hms, srt_time."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "seconds_to_hms(s DOUBLE) RETURNS STRING": """CASE WHEN CAST(s AS BIGINT) >= 3600 THEN format_string('%d:%02d:%02d', floor(CAST(s AS BIGINT) / 3600), floor(CAST(s AS BIGINT) / 60) % 60, CAST(s AS BIGINT) % 60)
        ELSE format_string('%d:%02d', floor(CAST(s AS BIGINT) / 60), CAST(s AS BIGINT) % 60) END""",
    "parse_time(t STRING) RETURNS BIGINT": r"""CASE WHEN trim(t) RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' THEN try_cast(try_cast(trim(t) AS DOUBLE) AS BIGINT)
        WHEN size(split(t, ':')) = 2 THEN try_cast(trim(split(t, ':')[0]) AS BIGINT) * 60 + try_cast(trim(split(t, ':')[1]) AS BIGINT)
        WHEN size(split(t, ':')) = 3 THEN try_cast(trim(split(t, ':')[0]) AS BIGINT) * 3600 + try_cast(trim(split(t, ':')[1]) AS BIGINT) * 60 + try_cast(trim(split(t, ':')[2]) AS BIGINT) END""",
    "srt_time(t STRING) RETURNS DOUBLE": """CASE WHEN size(split(t, ':')) = 3 THEN try_cast(split(t, ':')[0] AS DOUBLE) * 3600 + try_cast(split(t, ':')[1] AS DOUBLE) * 60 + try_cast(replace(trim(split(t, ':')[2]), ',', '.') AS DOUBLE)
        WHEN size(split(t, ':')) = 2 THEN try_cast(split(t, ':')[0] AS DOUBLE) * 60 + try_cast(replace(trim(split(t, ':')[1]), ',', '.') AS DOUBLE) END""",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
