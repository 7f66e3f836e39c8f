"""Pairs of similar sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import scratch, shared_folder

#: Rows of equal sets that are paired as one.
PART = 256


def similar_sets(df: DataFrame, id_col: str, items_col: str, least: float) -> DataFrame:
    """(a, b, sim): pairs a < b of ids whose sets have a Jaccard similarity of
    ``least`` or more. Empty and null sets are in no pair, null ids neither; rows that
    share an id are one set together.

    Equal sets are one class, and only classes are compared: with their items from
    the rarest on, two similar classes of n items share one of the first
    n - ceil(least * n) + 1. They meet there by a join, the lengths and the places of
    the item bound what they can share, and a pair counts at the first item that
    it shares. Similar classes are then paired row by row, in parts of about PART rows
    each way that are dealt evenly, so neither a common item nor a large class
    stays with one task. All pairs of rows are returned, which grow with the square
    of a class; what the lazy result reads stays in the shared folder.
    """
    spark, c = df.sparkSession, F.col

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := shared_folder(spark, name))
        return spark.read.schema(df.schema).parquet(path)

    with scratch(spark) as put:
        rows = df.where(c(id_col).isNotNull() & (F.size(items_col) > 0)).groupBy(c(id_col).alias("id"))
        rows = put(rows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(items_col)))).alias("s")), "set-rows")
        classes = put(rows.groupBy("s").agg(F.min("id").alias("x"), F.count("*").alias("n")), "set-classes")
        part = F.pmod(F.xxhash64("id"), F.ceil(c("n") / PART))
        parts = rows.join(classes, "s").groupBy("x", part.alias("part")).agg(F.collect_list("id").alias("ids"))
        parts = kept(parts, "set-parts")

        each = classes.select("x", F.explode("s").alias("item"))
        rare = each.groupBy("item").agg(F.count("*").alias("df"))
        order = F.transform(F.array_sort(F.collect_list(F.struct("df", "item"))), lambda p: p["item"])
        sets = each.join(rare, "item").groupBy("x").agg(order.alias("s")).select("x", "s", F.size("s").alias("k"))
        first = F.slice("s", F.lit(1), c("k") - F.ceil(c("k") * least - 1e-9).cast("int") + 1)
        posts = put(sets.select("x", "s", "k", F.posexplode(first).alias("i", "item")), "set-posts")
        a, b = posts.toDF("x", "sa", "ka", "ia", "item"), posts.toDF("y", "sb", "kb", "ib", "item")
        long = (c("ka") >= least * c("kb") - 1e-9) & (c("kb") >= least * c("ka") - 1e-9)
        most = F.least(c("ka") - c("ia"), c("kb") - c("ib"))
        far = (1 + least) * most >= least * (c("ka") + c("kb")) - 1e-9
        pairs = a.join(b, "item").where((c("x") < c("y")) & long & far)
        pairs = pairs.select("x", "y", "item", "ka", "kb", F.array_intersect("sa", "sb").alias("both"))
        sim = F.size("both") / (c("ka") + c("kb") - F.size("both"))
        pairs = pairs.where(c("both")[0] == c("item")).select("x", "y", sim.alias("sim")).where(c("sim") >= least)
        alone = classes.where("n > 1").select("x", c("x").alias("y"), F.lit(1.0).alias("sim"))
        pairs = kept(pairs.unionByName(alone), "set-pairs")

    left, right = parts.select("x", c("part").alias("p"), c("ids").alias("a")), parts.select(c("x").alias("y"), c("part").alias("q"), c("ids").alias("b"))
    dealt = pairs.join(left, "x").join(right, "y").where((c("x") != c("y")) | (c("p") <= c("q")))
    same = (c("x") == c("y")) & (c("p") == c("q"))
    dealt = dealt.select("a", "b", "sim", same.alias("same")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = dealt.select("sim", "same", "b", F.explode("a").alias("i")).select("sim", "same", "i", F.explode("b").alias("j"))
    return each.where((c("i") < c("j")) | ~c("same")).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "sim")
