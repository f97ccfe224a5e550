"""Null-aware numeric expressions. A missing value is NULL, never NaN, so NaN and infinities become NULL first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Knots = tuple[tuple[float, float], ...]


def finite(c: Column) -> Column:
    """The value as a double; NULL if it is missing, no number, NaN or infinite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Clipped, NULL staying NULL (least and greatest skip NULLs)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def pct_over(c: Column, base: Column) -> Column:
    """(c / base - 1) * 100; NULL where base is 0."""
    return (F.try_divide(c, base) - 1) * 100


def piecewise(c: Column, knots: Knots) -> Column:
    """Linear between knots and flat beyond them, clipped to 0..100; NULL stays NULL."""
    knots = tuple(sorted((float(x), min(max(float(y), 0.0), 100.0)) for x, y in knots))
    (x0, y0), *rest = knots
    out = F.when(c.isNull(), F.lit(None).cast("double")).when(c <= x0, F.lit(y0))
    for x1, y1 in rest:
        out = out.when(c <= x1, F.lit(y0) + (c - x0) * F.lit((y1 - y0) / (x1 - x0)))
        x0, y0 = x1, y1
    return out.otherwise(F.lit(y0))


def weighted(parts: Iterable[tuple[Column, int]]) -> tuple[Column, Column]:
    """(mean of the present parts by weight, present weight in per cent). Weights are integers, so coverage is exact."""
    parts = list(parts)
    have = total = None
    for c, w in parts:
        v = F.coalesce(c * w, F.lit(0.0))
        n = F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0))
        have, total = (v, n) if have is None else (have + v, total + n)
    return clip(have / F.when(total > 0, total)), total * F.lit(100.0) / F.lit(sum(w for _, w in parts))
