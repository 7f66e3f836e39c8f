"""Row numbers and running sums without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sliced(df: DataFrame, keys: list[str], put) -> DataFrame:
    """``df`` sorted by range over all tasks, with the task's number ``_p`` and the
    row's place ``_r`` in it. ``put`` writes a table and reads it again, as a range
    sort must not be repeated."""
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return put(ranged.select("*", F.shiftright(at, 33).cast("int").alias("_p"), at.bitwiseAND((1 << 33) - 1).alias("_r")), "slices")


def _moved(marked: DataFrame, groups: list[str], counts: DataFrame, shift) -> DataFrame:
    """Slices with what stands before them in their group: ``counts`` has a row for
    each task and group in it, so a group has as many as tasks at most."""
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), F.col("_p").alias("_q"), shift(F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_shift"))
    same = F.col("_p") == F.col("_q")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return marked.join(held, same)


def places(df: DataFrame, groups: list[str], order: list[str], name: str, put, slices: str | None = None) -> DataFrame:
    """``df`` with the number of each row in its group, from 1 in ``order``, as
    ``name``; rows alike in both are numbered in any order. Rows are numbered within
    a task and moved on by what earlier tasks have of the same group. ``slices`` names
    a column for the number of the task, in whose order rows lie."""
    marked = _sliced(df, groups + order, put)
    counts = marked.groupBy(*groups, "_p").agg(F.count("*").alias("_n"), F.min("_r").alias("_first"))
    found = _moved(marked, groups, counts, lambda before: before - F.col("_first")).withColumn(name, F.col("_r") + F.col("_shift") + 1)
    return found.select(*df.columns, name, *([F.col("_p").alias(slices)] if slices else []))


def running(df: DataFrame, groups: list[str], order: list[str], weight: str, name: str, put) -> DataFrame:
    """``df`` with the sum of ``weight``, a whole number, over the rows of its group
    up to each row in ``order``. Sums run within a task's part of a group and are
    moved on by what earlier tasks have of it."""
    marked = _sliced(df, groups + order, put)
    own = Window.partitionBy("_p", *groups).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_s", F.sum(weight).over(own))
    counts = marked.groupBy(*groups, "_p").agg(F.sum(weight).alias("_n"))
    return _moved(marked, groups, counts, lambda before: before).select(*df.columns, (F.col("_s") + F.col("_shift")).alias(name))
