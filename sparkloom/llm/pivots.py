"""Embedding near-dedup through a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from .common import stage
from .components import connected_components
from .simhash import _Groups

#: Nearest pivots that describe a vector, those that it is listed under, and
#: how many two vectors must share to be compared.
DESCRIBED, LISTED, SHARED = 8, 3, 2
MAX_PIVOTS = 4096
#: Cosines that pivots stay below among each other, the first as long as that gives enough of them.
APART = (0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 2.0)
LIST_BLOCK = 4096
QUERY_BLOCK = 512


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, brought to a largest entry of one first, as squares of
    very large or small entries leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows that lie as far from each other as the rows allow: first
    those that are not within the smallest cosine of APART of one before, then, as
    long as there are too few, further ones by the next larger. Pivots of one tight
    cluster rank by noise, and near vectors then share few of them; but a cluster
    with a single pivot is one list."""
    kept, open_ = np.zeros((0, x.shape[1])), np.ones(len(x), bool)
    for limit in APART:
        for k in np.flatnonzero(open_):
            if len(kept) == most:
                return kept
            if not len(kept) or (kept @ x[k]).max() < limit:
                kept, open_[k] = np.vstack((kept, x[k])), False
    return kept


def search_list(x: np.ndarray, signs: np.ndarray, block: np.ndarray, pair: tuple[int, int], floor: float, pivot: int):
    """Links among the vectors of one inverted list, as index arrays (i, j).

    ``signs`` has each vector's nearest pivots in order. Postings of all pivots
    within the list are counted for each query; vectors that share SHARED or
    more are candidates, and cosines in double precision decide. A pair that
    several lists hold is taken in that of the smallest pivot listed for both.
    Pairs are of a vector in the first block of ``pair`` and one in the second;
    within a block, each pair is taken once.
    """
    n = len(x)
    names, flat = np.unique(signs, return_inverse=True)
    flat = flat.reshape(signs.shape)
    member = np.zeros((n, len(names)), np.float32)
    member[np.arange(n)[:, None], flat] = 1
    listed = signs[:, :LISTED]
    queries, others = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
    posted = member[others].T
    for at in range(0, len(queries), QUERY_BLOCK):
        q = queries[at : at + QUERY_BLOCK]
        i, j = np.nonzero(member[q] @ posted >= min(SHARED, signs.shape[1]))
        i, j = q[i], others[j]
        if pair[0] == pair[1]:
            i, j = i[i < j], j[i < j]
        step = 1 << 18
        for b in range(0, len(i), step):
            a, c = i[b : b + step], j[b : b + step]
            near = np.einsum("ij,ij->i", x[a], x[c]) >= floor
            a, c = a[near], c[near]
            both = np.where((listed[a][:, :, None] == listed[c][:, None, :]).any(2), listed[a], np.iinfo(np.int32).max).min(1)
            yield a[both == pivot], c[both == pivot]


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     threshold: float = 0.95, pivots: int | None = None) -> DataFrame:
    """(id, n_links, component) per row of ``vectors``: rows linked directly, and
    the smallest id reachable.

    Pivots are drawn from the distinct vectors with the smallest hashes, as far
    from each other as ``apart`` finds them, two times the root of the number of
    distinct vectors and between 16 and MAX_PIVOTS: the sample is bounded
    (2 * MAX_PIVOTS), and lists grow with the root of the input up to MAX_PIVOTS
    pivots and with the input beyond. Every vector is
    described by its DESCRIBED nearest pivots in order, and listed under the
    first LISTED. Each list is a group of work; lists longer than LIST_BLOCK
    are dealt into pairs of blocks. Equal vectors are one node with a weight.
    A group returns one count for each vector and a spanning set of links.

    Vectors that are null, zero, or hold null or non-finite components link
    with nothing, and those of another length than the rest only with their
    like. A null id is never the smallest unless all ids of a component are
    null; rows that share an id and a vector count as two rows. Other columns
    are ignored; no rows give no rows. Pairs that share too few pivots are
    missed; no pair below the threshold is linked.
    """
    ship(vectors.sparkSession)
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = rows.where("sound").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    nodes = stage(nodes.withColumn("key", F.monotonically_increasing_id()), "vectors")  # numbers, as two vectors may share a hash
    lengths = sorted(r[0] for r in nodes.select(F.size("v")).distinct().collect())  # one entry for each number of dimensions
    links, counts = None, None
    for dims in lengths:
        part = nodes.where(F.size("v") == dims)
        a, b = _links(part, threshold, pivots)
        links, counts = (a, b) if links is None else (links.union(a), counts.union(b))
    spark = vectors.sparkSession
    if links is None:
        links, counts = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "key long, n long")
    linked = connected_components(links)
    total = counts.groupBy("key").agg(F.sum("n").alias("n"))
    named = nodes.join(linked, nodes["key"] == linked["node"], "left").join(total, "key", "left").select(
        "v", "low", "weight", F.coalesce("component", "key").alias("label"), F.coalesce("n", F.lit(0)).alias("n")
    )
    lowest = named.groupBy("label").agg(F.min("low").alias("component"))
    classes = named.join(lowest, "label").select("v", "weight", "n", "component")
    keyed = rows.select("id", F.when(F.col("sound"), F.col("v")).alias("v"))
    return keyed.join(classes, "v", "left").select(
        "id", F.coalesce(F.col("n") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("weight").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"),
    )


def _links(nodes: DataFrame, threshold: float, pivots: int | None) -> tuple[DataFrame, DataFrame]:
    """Spanning links (src, dst) and weighted link counts (key, n) of vectors of
    one length."""
    m = pivots or int(np.clip(np.ceil(2 * np.sqrt(nodes.count())), 16, MAX_PIVOTS))
    drawn = nodes.select("v", F.xxhash64("v", F.lit(5)).alias("h")).orderBy("h").limit(2 * m).toPandas()["v"]
    points = apart(_unit(np.array(drawn.tolist(), np.float64)), m)

    def describe(batches):
        for pdf in batches:
            x = _unit(np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1))
            near = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :DESCRIBED].astype(np.int32)
            yield pdf.assign(signs=list(near))

    described = nodes.select("key", "weight", "v").mapInPandas(describe, "key long, weight long, v array<double>, signs array<int>")
    described = stage(described, "described")
    listed = described.select("*", F.explode(F.slice("signs", 1, LISTED)).alias("pivot"))
    sizes = described.select(F.explode(F.slice("signs", 1, LISTED)).alias("pivot")).groupBy("pivot").agg(
        F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks")
    )  # one row for each pivot, MAX_PIVOTS at most
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = listed.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(every).alias("other")).select(
        "key", "weight", "v", "signs", "pivot", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.array(pdf["v"].tolist(), np.float64))
        signs = np.array(pdf["signs"].tolist(), np.int32)
        key, weight, block = (pdf[c].to_numpy() for c in ("key", "weight", "block"))
        i, j, pivot = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(pdf["pivot"].iloc[0])
        groups, n = _Groups(len(pdf)), np.zeros(len(pdf), np.int64)
        for a, b in search_list(x, signs, block, (i, j), threshold, pivot):
            np.add.at(n, a, weight[b])
            np.add.at(n, b, weight[a])
            groups.link(a, b)
        to = np.flatnonzero(n)
        return pd.DataFrame({"key": key[to], "n": n[to], "root": key[groups.label[to]]})

    found = dealt.groupBy("pivot", "i", "j").applyInPandas(search, "key long, n long, root long")
    found = stage(found, "links")
    return found.where("key <> root").select(F.col("key").alias("src"), F.col("root").alias("dst")), found.select("key", "n")
