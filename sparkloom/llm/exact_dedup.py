"""Exact dedup: tree-merge of sorted digest runs, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stage, text_or_empty

BLANKS = r"[\x20\x09-\x0D]+"
#: What tells texts apart: digest, length, second hash.
KEY = ["d", "n", "h"]
#: A group with more than this fraction of all rows is large.
HOT = 1024


def merge_round(level: DataFrame, fan_in: int) -> DataFrame:
    """The runs of ``level`` (run, shard, d, n, h, low, rows) merged ``fan_in``
    neighbours at a time: the runs of a group meet in one partition for each
    shard of the digests, are merged in the order of their keys, and of equal
    neighbours the first, with the smallest id, stays with the rows of all."""
    moved = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("run", "shard")
    same = Window.partitionBy("run", "shard", *KEY).orderBy(F.col("low").asc_nulls_last())
    counted = moved.withColumns({"at": F.row_number().over(same), "all": F.sum("rows").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return counted.where("at = 1").select("run", "shard", *KEY, "low", F.col("all").alias("rows"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space became
    one space. A document belongs to one of ``runs`` runs by a hash of its id.
    Each run is reduced to one entry per digest and sorted by digest; then rounds
    of ``merge_round`` are written, sorted, until one run is left. An entry holds
    the smallest id and the number of rows, so a group of copies of any size
    sends at most one entry per run to any task. Entries are merged only when
    SHA-256, length and a second 64-bit hash all agree.

    Groups of more than a HOT-th of all rows, fewer than HOT, are given to their
    rows by a broadcast, so that none of them meets in one task; the others by a
    join on the digest.

    Null text counts as empty; empty texts are equal to each other. Of rows
    that share both the smallest id and the text, each is kept. A null id is
    never the smallest unless the whole group has null ids; then keep_id is
    null and all its rows are kept. Other columns are ignored; no rows give
    no rows.
    """
    spark = docs.sparkSession
    clean = F.regexp_replace(text_or_empty(docs, text_col), BLANKS, " ")
    keyed = (
        docs.select(docs[id_col].alias("_id"), clean.alias("_t"))
        .select("_id", F.unhex(F.sha2("_t", 256)).alias("d"), F.length("_t").alias("n"), F.xxhash64("_t").alias("h"))
    )
    keyed = stage(keyed, "digests")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark) as put:
        level = (
            keyed.select("*", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(runs)).cast("int").alias("run"),
                         F.pmod(F.hash("d"), F.lit(shards)).alias("shard"))
            .groupBy("run", "shard", *KEY).agg(F.min("_id").alias("low"), F.count("*").alias("rows"))
        )
        level = put(level.sortWithinPartitions("run", "shard", *KEY), "runs")
        while runs > 1:
            level = put(merge_round(level, fan_in).sortWithinPartitions("run", "shard", *KEY), "runs")
            runs = -(-runs // fan_in)
        several = stage(level.where("rows > 1").select(*KEY, "low", "rows"), "copies")
    hot = F.col("rows") * HOT > keyed.count()
    large = F.broadcast(several.where(hot))  # fewer than HOT rows
    rest = keyed.join(F.broadcast(several.where(hot).select(*KEY)), KEY, "left_anti").join(several.where(~hot), KEY, "left")
    out = keyed.join(large, KEY).unionByName(rest)
    keep = F.when(F.col("rows").isNull(), F.col("_id")).otherwise(F.col("low"))
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("d")).alias("text_sha256"),
    )
