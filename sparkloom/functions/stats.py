"""Ratios, intervals and percentiles with their null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """Rounded share, null where the denominator is not positive: never a misleading zero."""
    return F.when(den > 0, F.round(num / den, digits))


def ratio_or_zero(num: Column, den: Column, digits: int = 6) -> Column:
    """Rounded share, zero where the denominator is not positive."""
    return F.coalesce(ratio(num, den, digits), F.lit(0.0))


def floor_percentile(values: Column, p: float) -> Column:
    """The value at floor(n * p) of an array column, the last one at most."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.least(n - 1, F.floor(n * p).cast("int")))


def wilson(successes: Column, total: Column, z: float = 1.96) -> dict[str, Column]:
    """Bounds of the Wilson score interval, from 0 to 1."""
    p, zz = successes / total, z * z
    centre, den = p + zz / (2 * total), 1 + zz / total
    margin = z * F.sqrt((p * (1 - p) + zz / (4 * total)) / total)
    return {
        "lower": F.greatest(F.lit(0.0), (centre - margin) / den),
        "upper": F.least(F.lit(1.0), (centre + margin) / den),
    }


def z_value(level: Column) -> Column:
    """Quantile of the normal distribution for a two-sided level; a level above 1
    is a quantile already."""
    return (
        F.when(level > 1, level).when(level >= 0.99, 2.576).when(level >= 0.95, 1.96).when(level >= 0.90, 1.645)
        .when(level >= 0.80, 1.282).otherwise(1.96)
    )


def confidence_bin(confidence: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.floor(confidence * bins).cast("int"))
