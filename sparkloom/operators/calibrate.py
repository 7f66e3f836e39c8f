"""Calibration of predictions in a tree, by depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tree
from ..sources.staging import scratch, staged
from .ranks import running

#: Bins of the calibration error.
BINS = 10


def tier_thresholds(rows: DataFrame, groups: list[str], confidence: str, put, abstain: float = 0.15, auto: float = 0.9) -> DataFrame:
    """(groups, abstain_below, review_above): the confidences at two shares of a
    group's sorted rows, the upper one at least 0.05 above the lower. Equal
    confidences are one row with a count, and their running counts come from a sort
    over all tasks, so no task holds a group."""
    counted = rows.groupBy(*groups, F.col(confidence).alias("_v")).agg(F.count("*").alias("_c"))
    upto = put(running(counted, groups, ["_v"], "_c", "_upto", put), "tiers")
    size = upto.groupBy(*groups).agg(F.max("_upto").alias("_size")) if groups else upto.agg(F.max("_upto").alias("_size"))
    met = upto.join(size, groups) if groups else upto.join(F.broadcast(size))

    def at(share: float) -> Column:
        place = F.least(F.col("_size") - 1, F.floor(F.col("_size") * share))
        return F.min(F.when(F.col("_upto") > place, F.col("_v")))

    cuts = met.groupBy(*groups).agg(at(abstain).alias("_a"), at(auto).alias("_b"))
    return cuts.select(*groups, F.round("_a", 3).alias("abstain_below"), F.round(F.greatest(F.col("_b"), F.col("_a") + 0.05), 3).alias("review_above"))


def depth_calibration(pairs: DataFrame, depth: str, confidence: str, gold: str, predicted: str, least_support: int = 10) -> DataFrame:
    """(depth, n, sufficient, exact, ancestor, tree_distance, ece, abstain_below,
    review_above): how predicted nodes of a tree differ from the gold ones, by
    ``depth``. Paths hold names from the root to the node. ``ancestor``: the share of
    rows that are exact or differ in the last name alone; ``tree_distance``: mean steps
    over the lowest common ancestor; ``ece``: calibration error over BINS bins.
    Depths of fewer than ``least_support`` rows take the thresholds of all rows. A null
    depth is a group; rows of null confidence are left out."""
    with scratch(pairs.sparkSession) as put:
        g, p = F.col(gold), F.col(predicted)
        right = g.eqNullSafe(p)
        above = lambda path: F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
        rows = put(
            pairs.where(F.col(confidence).isNotNull()).select(
                F.coalesce(F.col(depth).cast("string"), F.lit("")).alias("_k"), F.col(depth).alias("_d"), F.col(confidence).cast("double").alias("_conf"), right.cast("int").alias("_hit"),
                (right | ((F.size(g) > 1) & (above(g) == above(p)))).cast("int").alias("_near"), F.when(right, 0).otherwise(tree.distance(g, p)).alias("_far"),
            ), "calibration",
        )
        in_bin = F.least(F.floor(F.col("_conf") * BINS), F.lit(BINS - 1)).alias("_bin")
        bins = rows.groupBy("_k", in_bin).agg(F.first("_d").alias("_d"), F.count("*").alias("n"), F.sum("_hit").alias("hit"), F.sum("_near").alias("near"), F.sum("_far").alias("far"), F.sum("_conf").alias("conf"))
        n = F.sum("n")
        by_depth = bins.groupBy("_k").agg(
            F.first("_d").alias("depth"), n.alias("n"), (F.sum("hit") / n).alias("exact"), (F.sum("near") / n).alias("ancestor"), (F.sum("far") / n).alias("tree_distance"),
            (F.sum(F.abs(F.col("hit") - F.col("conf"))) / n).alias("ece"),
        )
        own = tier_thresholds(rows, ["_k"], "_conf", put)
        all_ = tier_thresholds(rows, [], "_conf", put).toDF("_a", "_b")  # one row
        enough = F.col("n") >= least_support
        found = by_depth.join(own, "_k").join(F.broadcast(all_))
        return staged(
            found.select(
                "depth", "n", enough.alias("sufficient"), "exact", "ancestor", "tree_distance", "ece",
                F.when(enough, F.col("abstain_below")).otherwise(F.col("_a")).alias("abstain_below"), F.when(enough, F.col("review_above")).otherwise(F.col("_b")).alias("review_above"),
            ), "calibrated",
        )
