"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another node;
    component is the smallest node reachable.

    Each round rewires every node to the smallest neighbour it sees, so paths
    shrink by a factor and O(log n) rounds suffice. Rounds are staged tables;
    only a count and one checksum reach the driver. Self loops and repeated
    edges are ignored; no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    with scratch(edges.sparkSession) as put:
        e = put(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
        before = _signature(e)
        while before[0]:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = (
                both.join(low, "u").where("v > u")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            )
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (
                large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(low.select("u", F.col("m").alias("v"))).distinct()
            )
            e = put(small, "edges")
            now = _signature(e)
            if now == before:
                break
            before = now
        named = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
        return stage(named.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
