"""Bit strings that differ in few places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from ..sources.staging import scratch, staged

#: Distinct keys of a block in the smallest case; blocks grow with the root of their number.
ROWS_A_BLOCK = 1 << 14
#: Pairs that are compared at once, and found pairs that are returned at once.
PAIRS, FOUND = 1 << 18, 1 << 14


def bits_to_long(bits):
    """A text of at most 64 zeros and ones as a long."""
    padded = F.lpad(bits, 64, "0")
    return F.conv(padded, 2, -10).cast("long")


def near_keys(keys: DataFrame, id_col: str, bits_col: str, radius: int, blocks: int = 4) -> DataFrame:
    """(a, b, distance, n_a, n_b): pairs of different bit strings of one length, of up
    to 64 places, that differ in at most ``radius`` of them. Equal strings are one,
    named by its smallest id and with its number of rows, so copies are not paired.

    The 64 bits fall into ``blocks`` blocks. Where these are more than the radius,
    two strings within it agree in a block: each is listed under its blocks' values,
    and a pair counts at the first block where it meets, so none comes twice. How
    many strings share a value follows the data: lists of a value are split where a
    join is skewed. With a wider radius each string would have to ask thousands of
    values of every block, so there all are compared, see ``_compared``. Null
    strings, empty ones and such of other characters or more than 64 places are left
    out, and so are those whose ids are all null.
    """
    if 64 % blocks or not 0 <= radius < 64:
        raise ValueError("blocks divide 64, and the radius is below it")
    fine = F.col(bits_col).rlike("^[01]{1,64}$")
    one = keys.where(fine).groupBy(F.length(bits_col).alias("size"), bits_to_long(F.col(bits_col)).alias("v")).agg(F.min(id_col).alias("id"), F.count("*").alias("n"))
    one = one.where(F.col("id").isNotNull())
    found = _agreeing(one, radius, blocks) if radius < blocks else _compared(one, radius)
    first = F.col("x") < F.col("y")
    n_a, n_b = (F.when(first, F.col(p)).otherwise(F.col(q)) for p, q in (("n", "m"), ("m", "n")))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance", n_a.alias("n_a"), n_b.alias("n_b"))


def _agreeing(one: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(x, y, distance, n, m) of the pairs, which agree in one of the blocks."""
    width = 64 // blocks

    def block(value, k):
        return F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1))

    listed = one.select("size", "v", "id", "n", F.posexplode(F.array(*(block("v", k) for k in range(blocks)))).alias("k", "part"))
    asks = listed.select("size", F.col("v").alias("w"), F.col("id").alias("y"), F.col("n").alias("m"), "k", "part")
    met = listed.join(asks, ["size", "k", "part"]).where(F.col("id") < F.col("y"))
    apart = F.col("v").bitwiseXOR(F.col("w"))
    first = F.lit(blocks)
    for k in reversed(range(blocks)):
        first = F.when(block(apart, k) == 0, F.lit(k)).otherwise(first)
    distance = F.bit_count(apart)
    return met.where((distance <= radius) & (first == F.col("k"))).select(F.col("id").alias("x"), "y", distance.cast("int").alias("distance"), "n", "m")


def _compared(one: DataFrame, radius: int) -> DataFrame:
    """(x, y, distance, n, m) of the pairs, in either order. The keys fall into blocks
    by hash, and each pair of blocks is one group of work, which compares its keys
    in numpy and returns what it finds in parts, however many pairs are near.
    The work grows with the square of the distinct keys, what is sent by their power of 1.5."""
    spark = one.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids, v, n, block = t["id"].combine_chunks(), t["v"].to_numpy().view(np.uint64), t["n"].to_numpy(), t["block"].to_numpy()
        left, right = np.flatnonzero(block == t["i"][0].as_py()), np.flatnonzero(block == t["j"][0].as_py())
        same, step = t["i"][0].as_py() == t["j"][0].as_py(), max(1, PAIRS // max(1, len(right)))
        held, size = [], 0
        for at in range(0, len(left), step):
            d = np.bitwise_count(v[left[at : at + step], None] ^ v[None, right])
            x, y = np.nonzero(d <= radius)
            use = x + at < y if same else slice(None)
            held.append((left[at + x[use]], right[y[use]], d[x, y][use]))
            size += len(held[-1][0])
            if size >= FOUND or at + step >= len(left):
                x, y, d = (np.concatenate(c) for c in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(d.astype(np.int32)), pa.array(n[x]), pa.array(n[y])], names=["x", "y", "distance", "n", "m"])
                held, size = [], 0

    with scratch(spark) as put:
        one = put(one, "near-keys")
        g = 8 * max(1, int(np.ceil(np.sqrt(one.count() / 8 / ROWS_A_BLOCK))))
        block = F.pmod(F.xxhash64("v"), F.lit(g)).cast("int")
        dealt = one.select("size", "v", "id", "n", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("other"))
        dealt = dealt.select("size", "v", "id", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        kind = one.schema["id"].dataType.simpleString()
        return staged(dealt.groupBy("size", "i", "j").applyInArrow(run, f"x {kind}, y {kind}, distance int, n long, m long"), "near-pairs")
