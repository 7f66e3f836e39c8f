"""Differences between two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(df: DataFrame, key: str, names: list[str], out: str) -> DataFrame:
    return df.unpivot([key], names, "field", out).where(F.col(out).isNotNull())


def fields(old: DataFrame, new: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, field, before, after, change) for every field that differs."""
    both = _long(old, key, names, "before").join(_long(new, key, names, "after"), [key, "field"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, "field", "before", "after", change.alias("change"))


def reconcile(known: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, outcome): inserted if only observed, deactivated if only known, else refreshed."""
    a = known.select(key).distinct().withColumn("_known", F.lit(True))
    b = observed.select(key).distinct().withColumn("_seen", F.lit(True))
    outcome = F.when(F.col("_known").isNull(), "inserted").when(F.col("_seen").isNull(), "deactivated").otherwise("refreshed")
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))


def sync_plan(current: DataFrame, desired: DataFrame, key: str, digest: str, stale: Column) -> DataFrame:
    """(key, action): noop where the digests agree, upsert where they don't or the
    row is missing; unknown current rows are deleted if ``stale``, else get a tombstone."""
    d = desired.select(key, F.col(digest).alias("_want"), F.lit(True).alias("_desired"))
    c = current.withColumn("_current", F.lit(True))
    action = (
        F.when(F.col("_current").isNull(), "upsert")
        .when(F.col("_desired") & (F.col(digest) == F.col("_want")), "noop").when(F.col("_desired"), "upsert")
        .when(stale, "delete").otherwise("tombstone")
    )
    return c.join(d, key, "full_outer").select(key, action.alias("action"))


def digest(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One row that two tables share, in whatever order, if their rows are the
    same: count, exclusive or and a modular sum of 60-bit row hashes."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    h = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(
        F.lit(name).alias("tbl"), F.count("*").alias("n_rows"), F.bit_xor("h").alias("x"), F.sum(F.col("h") % 1000003).alias("s")
    )
