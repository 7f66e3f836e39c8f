"""Names that no two rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import scratch, staged
from .ranks import places

#: Characters of a stem, a counter included.
STEM_LIMIT = 80


def _candidate(name: Column, number: Column) -> Column:
    """The name itself for 0, then with -2, -3, ... before its extension."""
    cut = F.length(name) - F.length(F.substring_index(name, ".", -1))
    dotted = F.contains(name, F.lit("."))
    stem = F.when(dotted, F.substring(name, F.lit(1), cut - 1)).otherwise(name)
    ext = F.when(dotted, F.substring(name, cut, F.length(name))).otherwise(F.lit(".html"))
    suffix = F.concat(F.lit("-"), (number + 1).cast("string"))
    short = F.rtrim(F.substring(stem, F.lit(1), F.lit(STEM_LIMIT) - F.length(suffix)), F.lit("-"))
    return F.when(number == 0, name).otherwise(F.concat(short, suffix, ext))


def allocate_names(wanted: DataFrame, key: str, name: str, taken: DataFrame | None = None) -> DataFrame:
    """(key, name, wanted): every row gets a name of its own, as if one row after the
    other, by key, took the first of name, name-2, name-3, ... that is free. Names
    are alike in either case; those in the first column of ``taken`` are in use.

    Rows ask all at once, and again in rounds: of those that ask for one name the
    smallest key gets it, the others go on to their next. As every name prefers small
    keys, that ends where the sequence would. Rows that want the same name start at
    candidates of their own, by their number among them, and keep that order, so a
    name wanted by many rows takes no more rounds than one wanted by few; they are
    numbered by a sort over all tasks, and no task holds all of them.

    Keys are unique and not null; null and empty names are left out.
    """
    spark = wanted.sparkSession
    with scratch(spark) as put:
        rows = wanted.where(F.length(name) > 0).select(F.col(key).alias("key"), F.col(name).alias("base"), F.lower(name).alias("low"))
        rows = put(places(rows, ["low"], ["key"], "place", put, slices="slice"), "names")
        used = None if taken is None else put(taken.select(F.lower(taken.columns[0]).alias("asked")).distinct(), "names-taken")
        ask = rows.withColumn("at", F.col("place") - 1)
        while True:
            ask = put(ask.withColumn("name", _candidate(F.col("base"), F.col("at"))).withColumn("asked", F.lower("name")), "names-asked")
            first = ask.groupBy("asked").agg(F.min("key").alias("winner"))
            if used is not None:
                first = first.join(used, "asked", "left_anti")
            lost = put(ask.join(first, (ask["asked"] == first["asked"]) & (ask["key"] == first["winner"]), "left_anti").select("key"), "names-lost")
            if lost.isEmpty():
                return staged(ask.select(F.col("key").alias(key), "name", F.col("base").alias("wanted")), "allocated")
            lost = lost.withColumn("bump", F.lit(1))
            moved = ask.join(lost, "key", "left").select("key", "base", "low", "place", "slice", (F.col("at") + F.coalesce("bump", F.lit(0)) - F.col("place")).alias("lead"))
            # a row stays behind all before it that want the same name: the running maximum, within slices and over them
            own = Window.partitionBy("slice", "low").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
            moved = put(moved.withColumn("lead", F.max("lead").over(own)), "names-moved")
            ends = moved.groupBy("low", "slice").agg(F.max("lead").alias("end"))
            carried = ends.select("low", "slice", F.max("end").over(Window.partitionBy("low").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
            lead = F.greatest("lead", F.coalesce("carry", F.col("lead")))
            ask = moved.join(carried, ["low", "slice"]).select("key", "base", "low", "place", "slice", (F.col("place") + lead).alias("at"))
