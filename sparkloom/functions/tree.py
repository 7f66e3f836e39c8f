"""Paths in a tree, as arrays of names from the root on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_depth(a: Column, b: Column) -> Column:
    """The depth of the lowest common ancestor of two paths, themselves included:
    names that agree from the root on. 0 where a path is null or empty."""
    both = F.least(_size(a), _size(b))
    apart = F.array_position(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].eqNullSafe(x["b"])), False)
    return F.when(apart > 0, F.least(both, apart.cast("int") - 1)).otherwise(both)


def _size(path: Column) -> Column:
    return F.coalesce(F.greatest(F.size(path), F.lit(0)), F.lit(0))


def distance(a: Column, b: Column) -> Column:
    """Steps from one node to the other over their lowest common ancestor."""
    return _size(a) + _size(b) - 2 * common_depth(a, b)
