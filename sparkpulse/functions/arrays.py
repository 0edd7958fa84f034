"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it (a lambda would compute it for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def corr(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation; null if either side is constant."""
    o = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return o(F.covar_pop(x, y)) / F.nullif(o(F.stddev_pop(x)) * o(F.stddev_pop(y)), F.lit(0.0))
