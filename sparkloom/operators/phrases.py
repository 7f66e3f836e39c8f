"""Phrases of any number of words in texts, met by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels up to which they are broadcast, in words.
BROADCAST_WORDS = 2_000_000


def _lengths(labels: DataFrame, words: str) -> tuple[list[int], int]:
    """The numbers of words that labels have, and all their words together."""
    n = labels.groupBy(F.size(words).alias("n")).agg(F.count("*").alias("c")).where("n > 0").collect()
    return sorted(r["n"] for r in n), sum(r["n"] * r["c"] for r in n)


def _small(df: DataFrame, words: int) -> DataFrame:
    return F.broadcast(df) if words <= BROADCAST_WORDS else df


def phrase_matches(texts: DataFrame, id_col: str, words_col: str, labels: DataFrame, label_col: str, label_words: str, longest: bool = False) -> DataFrame:
    """(id_col, label_col, at, n): where the words of a label stand in a text, ``at``
    counted from 0. Both sides bring their words as arrays, so case and separators
    are the caller's. A text posts its runs of just the lengths that labels have, by
    hash; what meets is compared word by word. Labels are broadcast while their words
    are counted to be few. With ``longest``, at each place only the labels of most
    words stay. Null and empty labels match nothing, null texts hold nothing; equal
    labels match alike, and repeated ids keep their rows."""
    lengths, words = _lengths(labels, label_words)
    if not lengths:
        return texts.select(id_col).join(labels.select(label_col), F.lit(False)).select(id_col, label_col, F.lit(0).alias("at"), F.lit(0).alias("n"))
    held = labels.where(F.size(label_words) > 0).select(label_col, F.col(label_words).alias("_l"), F.size(label_words).alias("n"), F.xxhash64(label_words).alias("_h"))
    w = F.col("_w")
    none = F.array().cast("array<struct<_h:bigint,at:int,n:int>>")

    def posts(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda p: F.struct(F.xxhash64(F.slice(w, p, F.lit(n))).alias("_h"), (p - 1).alias("at"), F.lit(n).alias("n")))
        return F.when(F.size(w) >= n, runs).otherwise(none)

    # the words pass through a generator, as they would otherwise be split anew for every run
    split = texts.where(F.col(words_col).isNotNull()).select(id_col, F.explode(F.array(words_col)).alias("_w"))
    posted = split.select(id_col, "_w", F.inline(F.flatten(F.array(*map(posts, lengths)))))
    found = posted.join(_small(held, words), ["_h", "n"]).where(F.slice(w, F.col("at") + 1, F.col("n")) == F.col("_l"))
    if longest:
        most = found.groupBy(id_col, "at").agg(F.max("n").alias("_m"))
        found = found.join(most.select(F.col(id_col).alias("_i"), F.col("at").alias("_a"), "_m"), F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("at") == F.col("_a")) & (F.col("n") == F.col("_m")))
    return found.select(id_col, label_col, "at", "n")


def longest_prefix(names: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """``names`` with the longest of ``keys`` that starts the name, letters in either
    case, and ends at a word's end; null without one. Names post their starts of just
    the numbers of words that keys have, so keys may be of any length."""
    lengths, words = _lengths(keys.select(F.split(F.lower(key), " ").alias("w")), "w")
    parts = F.split(F.lower(name), " ")
    starts = F.filter(F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, 1, n), " ")) for n in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    posted = names.select("*", F.explode_outer(starts).alias("_p"))
    held = keys.groupBy(F.lower(key).alias("_p")).agg(F.min(key).alias("match"))
    found = posted.join(_small(held, words), "_p", "left")
    best = F.max_by("match", F.when(F.col("match").isNotNull(), F.length("_p")))
    return found.groupBy(*names.columns).agg(best.alias("match"))
