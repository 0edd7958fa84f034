"""Times as text: parsing and formatting, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: Column | str, strict: bool = False) -> Column:
    """Seconds of ``m:ss``, ``h:mm:ss`` or a number (truncated).  Parts aren't range-checked and a sign belongs to the first
    part alone.  Anything else is null, or an error if strict."""
    t = F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    part = lambda i: F.trim(F.get(F.split(t, ":"), F.lit(i))).try_cast("bigint")
    n = F.size(F.split(t, ":"))
    clock = F.when(n == 2, part(0) * 60 + part(1)).when(n == 3, part(0) * 3600 + part(1) * 60 + part(2))
    number = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double").try_cast("bigint"))
    out = F.coalesce(number, clock)
    return F.when(out.isNull(), F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(t, F.lit("null"))))).otherwise(out).cast("bigint") if strict else out


def seconds_to_hms(c: Column | str) -> Column:
    """``H:MM:SS`` from one hour on, else ``M:SS``; fractions are cut."""
    s = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    h, m, sec = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%d:%02d", m, sec))


def srt_time(c: Column | str) -> Column:
    """Seconds of a cue time, two or three parts, comma or dot before the decimals."""
    t = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), ",", ".")
    p = F.split(t, ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(p) == 2, part(0) * 60 + part(1))
