"""Pandas UDFs for what no built-in function computes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def _common(a: str | None, b: str | None) -> str | None:
    """Longest common substring, letters of either case equal; the first of the longest, as in ``a``."""
    if a is None or b is None:
        return None
    x, y = a.lower(), b.lower()
    best = end = 0
    row = [0] * (len(y) + 1)
    for i, c in enumerate(x, 1):
        last = 0
        for j, d in enumerate(y, 1):
            keep = row[j]
            row[j] = last + 1 if c == d else 0
            if row[j] > best:
                best, end = row[j], i
            last = keep
    return a[end - best : end]


def longest_common_substring(a, b):
    """Column of the longest common substrings of two text columns."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_common(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(a, b)
