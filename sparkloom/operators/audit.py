"""Field audits: value statistics, spellings, near values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def field_stats(df: DataFrame, names: list[str], top: int) -> DataFrame:
    """(field, v, n, distinct_count, non_empty): the most frequent values of each
    field. Counting comes before the ranking, so the window sees values, not rows."""
    counts = df.unpivot([], names, "field", "v").where("v <> ''").groupBy("field", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("field").agg(F.count("*").alias("distinct_count"), F.sum("n").alias("non_empty"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "v"))
    best = counts.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")
    return best.join(F.broadcast(totals), "field").select("field", "v", "n", "distinct_count", "non_empty")  # one row a field


def duplicate_groups(values: DataFrame) -> DataFrame:
    """(kind, form, spellings, n_rows, canonical) of values in column ``v`` that
    differ only in case, outer blanks or separators; the most frequent spelling,
    or of equal ones the shortest, is canonical."""
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    forms = {"case": F.lower("v"), "trim": F.trim("v"), "separator": F.regexp_replace("v", "[^A-Za-z0-9]+", "")}
    each = counts.select("v", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("form")) for k, c in forms.items()))).alias("f"))
    return each.groupBy("f.kind", "f.form").agg(
        F.count("*").alias("spellings"), F.sum("n").alias("n_rows"), F.max_by("v", F.struct(F.col("n") * 1000 - F.length("v"), "v")).alias("canonical")
    ).where("spellings > 1")


def near_values(df: DataFrame, name: str, distance: int) -> DataFrame:
    """Pairs a < b of distinct values within an edit distance.

    Of two such values, cut in ``distance`` + 1 pieces, one piece of the shorter
    occurs in the longer at most ``distance`` places off. So each value posts
    its pieces, and all substrings that a piece of a value of a near length
    could be, and pairs meet on a piece instead of all with all.
    """
    v = df.select(F.col(name).alias("v")).distinct().withColumn("n", F.length("v"))
    k = distance + 1
    index = v.select("v", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(
        F.floor(i * F.col("n") / k).cast("int").alias("at"), F.floor((i + 1) * F.col("n") / k).cast("int").alias("to")
    ))).alias("i", "p")).select(
        "v", "n", "i", "p.at", F.expr("substring(v, p.at + 1, p.to - p.at)").alias("piece")
    )
    lengths = v.select("v", "n", F.explode(F.expr(f"sequence(greatest(1, n - {distance}), n)")).alias("m"))
    probes = lengths.select("v", "n", "m", F.posexplode(F.expr(f"sequence(0, {k - 1})")).alias("i", "_"))
    probes = probes.select("v", "m", "i", F.expr(f"cast(floor(i * m / {k}) as int)").alias("at"), F.expr(f"cast(floor((i + 1) * m / {k}) as int)").alias("to"))
    probes = probes.select("v", "m", "i", "at", "to", F.explode(F.expr(f"sequence(greatest(0, at - {distance}), at + {distance})")).alias("s"))
    probes = probes.select(F.col("v").alias("w"), F.col("m").alias("n"), "i", F.expr("substring(v, s + 1, to - at)").alias("piece")).distinct()
    pairs = index.join(probes, ["n", "i", "piece"]).where("v <> w").select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= distance)
