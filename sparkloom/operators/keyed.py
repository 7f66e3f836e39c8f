"""Rows by key: latest, paging, unique names, upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``. An aggregate and not a
    window: rows are reduced before the shuffle, so a hot key costs one row of
    each task."""
    row = F.struct(*df.columns)
    top = F.max_by(row, F.struct(*order))
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(top.alias("_row")).select("_row.*")


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` in order, with the count of all rows."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))


def after(df: DataFrame, cursor: dict[str, Column], size: int) -> DataFrame:
    """The next ``size`` rows behind a cursor, in the order of its columns."""
    names = list(cursor)
    past = [
        reduce(lambda a, b: a & b, [F.col(n) == cursor[n] for n in names[:k]] + [F.col(names[k]) > cursor[names[k]]])
        for k in range(len(names))
    ]
    return df.where(reduce(lambda a, b: a | b, past)).orderBy(*names).limit(size)


def uniquify(df: DataFrame, stem: str, order: str, out: str) -> DataFrame:
    """The first claimant of a stem has it plain, the n-th with -n behind it."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy(order))
    return df.withColumn("_n", n).withColumn(
        out, F.when(F.col("_n") == 1, F.col(stem)).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string")))
    ).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` over those of ``old`` with the same key; change is insert,
    update or keep. Keys are unique on either side."""
    names = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*names).alias("_old"))
    b = new.select(*keys, F.struct(*names).alias("_new"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("_new").isNull(), "keep").when(F.col("_old").isNull(), "insert").otherwise("update")
    pick = F.coalesce("_new", "_old")
    return both.select(*keys, *(pick[c].alias(c) for c in names), change.alias("change"))
