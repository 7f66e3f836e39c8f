"""Order-dependent clustering within blocks, in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import scratch, staged
from .ranks import places

#: Places of a block in the first round; each later one takes twice as many.
FIRST_ROUND = 64
#: Pairs that a round may propose for each of its sets before it is halved.
PAIRS_A_SET = 200


def _ranked(sets: DataFrame, put) -> DataFrame:
    """(block, at, n, items): items of a set from the rarest in its block on, ties by name."""
    each = sets.select("block", "at", F.explode("items").alias("item"))
    rare = each.groupBy("block", "item").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "item")))
    sorted_ = each.join(rare, ["block", "item"]).groupBy("block", "at").agg(F.transform(order, lambda x: x["item"]).alias("items"))
    return put(sorted_.select("block", "at", F.size("items").alias("n"), "items"), "cluster-sets")


def _posted(sets: DataFrame, least: float) -> DataFrame:
    """(block, item, at, n): two sets of similarity ``least`` share one of these items."""
    keep = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    return sets.select("block", "at", "n", F.explode(F.slice("items", F.lit(1), keep)).alias("item"))


def _similar(later: DataFrame, earlier: DataFrame, least: float) -> DataFrame:
    """(block, at, before): sets of ``later`` and those before them in ``earlier``
    whose Jaccard similarity is ``least`` or more."""
    a, b = _posted(later, least), _posted(earlier, least).select("block", "item", F.col("at").alias("before"), F.col("n").alias("m"))
    long = (F.col("m") >= least * F.col("n") - 1e-9) & (F.col("n") >= least * F.col("m") - 1e-9)
    pairs = a.join(b, ["block", "item"]).where((F.col("before") < F.col("at")) & long).select("block", "at", "before").distinct()
    pairs = pairs.join(later.select("block", "at", "items"), ["block", "at"])
    pairs = pairs.join(earlier.select("block", F.col("at").alias("before"), F.col("items").alias("others")), ["block", "before"])
    both = F.size(F.array_intersect("items", "others"))
    return pairs.where(both / (F.size("items") + F.size("others") - both) >= least).select("block", "at", "before")


def _led(round_: DataFrame, pairs: DataFrame, put) -> DataFrame:
    """(block, at) of the sets of a round that lead: those without a leader among
    the similar ones before them. A set leads once none of these is left, and goes
    once one of them leads; the first open set of a block always settles."""
    open_, edges, leaders = round_.select("block", "at"), pairs, None
    while True:
        leads = put(open_.join(edges.select("block", "at").distinct(), ["block", "at"], "left_anti"), "cluster-leads")
        leaders = leads if leaders is None else leaders.unionByName(leads)
        gone = put(edges.join(leads.withColumnRenamed("at", "before"), ["block", "before"], "left_semi").select("block", "at").distinct(), "cluster-gone")
        open_ = put(open_.join(leads, ["block", "at"], "left_anti").join(gone, ["block", "at"], "left_anti"), "cluster-open")
        if open_.isEmpty():
            return leaders
        edges = put(edges.join(gone, ["block", "at"], "left_anti").join(gone.withColumnRenamed("at", "before"), ["block", "before"], "left_anti"), "cluster-edges")


def leader_clusters(df: DataFrame, block: str, order: str, members: str, least: float) -> DataFrame:
    """(order, leader): rows of a block in order join the first leader whose set has
    a Jaccard similarity of ``least`` or more, else lead a cluster of their own.

    Equal sets of a block are one, as the first of them decides for all. The rest
    goes in rounds over all blocks at once: the next sets of each block, twice as
    many every time, meet each other, and their leaders then meet all sets behind
    them, most of which settle. Sets meet by a join on their rarest items, so no
    task holds a block, and copies of a template settle at its first leader and are
    never paired with each other. A round that would propose many pairs is halved;
    its size changes the work and not the result.

    ``order`` is unique; null sets count as empty ones, a null block is a block of
    its own, and an empty table gives no rows.
    """
    spark = df.sparkSession
    with scratch(spark) as put:
        items = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(members), F.array().cast("array<string>")), lambda x: x.isNotNull())))
        rows = put(df.select(F.to_json(F.struct(F.col(block).alias("b"))).alias("block"), F.col(order).alias("at"), items.alias("items")), "cluster-rows")
        first = put(rows.groupBy("block", "items").agg(F.min("at").alias("at")), "cluster-first")
        open_ = put(places(_ranked(first.where(F.size("items") > 0), put), ["block"], ["at"], "place", put), "cluster-places")
        settled, size, low = [], FIRST_ROUND, 0
        while (next_ := open_.agg(F.min("place")).first()[0]) is not None:
            low = max(low, next_ - 1)
            while True:
                now = open_.where(F.col("place") <= low + size)
                met = _posted(now, least).groupBy("block", "item").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0]
                if size <= FIRST_ROUND or met <= PAIRS_A_SET * now.count():
                    break
                size //= 2
            now = put(now, "cluster-round")
            leaders = now.join(_led(now, put(_similar(now, now, least), "cluster-pairs"), put), ["block", "at"], "left_semi")
            leaders = put(leaders, "cluster-leaders")
            joins = _similar(open_, leaders, least).groupBy("block", "at").agg(F.min("before").alias("leader"))
            done = put(joins.unionByName(leaders.select("block", "at", F.col("at").alias("leader"))), "cluster-settled")
            settled.append(done)
            open_ = put(open_.join(done, ["block", "at"], "left_anti"), "cluster-rest")
            low, size = low + size, 2 * size
        led = first.where(F.size("items") == 0).select("block", "at", F.col("at").alias("leader"))
        for done in settled:
            led = led.unionByName(done)
        named = first.join(led, ["block", "at"]).select("block", "items", "leader")
        return staged(rows.join(named, ["block", "items"]).select(F.col("at").alias(order), "leader"), "clusters")
