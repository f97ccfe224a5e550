"""Earlier score curves that the current model does not use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clip


def linear_score(c: Column, low: float, high: float) -> Column:
    """Position between low and high in per cent."""
    return clip((c - low) / (high - low) * 100)


def pullback_score(v: Column) -> Column:
    return F.when(v >= -3, 55.0).when(v >= -8, 100.0).when(v >= -15, 60 + (v + 15) / 7 * 40).when(v >= -25, 10 + (v + 25) / 10 * 50).when(v.isNotNull(), 0.0)


def earnings_timing_score(days: Column) -> Column:
    return F.when(days.isNull(), 50.0).when(days < 0, 70.0).when(days <= 3, 15.0).when(days <= 7, 35.0).when(days <= 21, 70.0).otherwise(100.0)


def ma_distance_score(d: Column) -> Column:
    return (
        F.when(d.isNull(), 50.0)
        .when(d < -15, 5.0)
        .when(d < -5, 5 + (d + 15) / 10 * 55)
        .when(d <= 5, 60 + (d + 5) / 10 * 40)
        .when(d <= 15, 100 - (d - 5) / 10 * 30)
        .when(d <= 30, 70 - (d - 15) / 15 * 40)
        .otherwise(20.0)
    )
