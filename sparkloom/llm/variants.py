"""Spelling variants: words one edit apart, and the common form that each belongs to.

Words are dealt into shards by ranges of (length, word) and, a second time, of
(length, word in reverse), so a shard holds a bounded number of words whatever
they look like. A query goes to the shards that its prefix reaches for edits in
its later part, and to those that its suffix reaches for edits in its earlier
part. A shard answers by ``wavelet.Words``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage
from .wavelet import Words

#: Words of a shard, and shards at most: beyond their product shards grow.
SHARD_WORDS, SHARDS = 1 << 14, 4096
#: Words drawn for a border between shards, and code points of a border.
DRAWN, BORDER = 64, 64
_TOP = "\U0010ffff"

RUN = r"[A-Za-zÀ-ÿ]+"
#: One in so many runs of a document loses a code point.
SLIP = 31


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, with their occurrences in all
    texts. Where crc32 of ``<id>:<run>`` is a multiple of SLIP, the run misses the
    code point at that number modulo its length. A null text has no runs, a null id
    is written as an empty one; repeated rows count as often as they come."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(docs[text_col].cast("string"), F.lit(f"({RUN})"), F.lit(1))
    found = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = F.translate("run", upper, upper.lower())
    found = found.select(run.alias("run"), F.crc32(F.concat("id", F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word")
    return found.select(word).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _borders(words: DataFrame, shards: int, total: int) -> tuple[list, list]:
    """Borders of the two orders, from a sample by hash of about DRAWN words a border."""
    if shards == 1:
        return [], []
    every = max(1, total // (shards * DRAWN))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select(F.length("word").alias("n"), F.substring("word", 1, BORDER).alias("a"), F.substring(F.reverse("word"), 1, BORDER).alias("b")).collect()

    def cut(keys: list) -> list:
        keys.sort()
        return sorted({keys[len(keys) * k // shards] for k in range(1, shards)}) if keys else []

    return cut([(r["n"], r["a"]) for r in drawn]), cut([(r["n"], r["b"]) for r in drawn])


def _reach(borders: list, length: int, prefix: str) -> range:
    """Shards that may hold words of ``length`` with ``prefix``."""
    return range(bisect_right(borders, (length, prefix)), bisect_right(borders, (length, prefix + _TOP)) + 1)


def _routes(words: DataFrame, borders: tuple[list, list]) -> DataFrame:
    """(side, shard, asks, word, n, length, first, last): each word as a member of a
    shard on either side (asks false), and as queries for words of its length and of
    one more. Edits before some position are asked of the reverse side, where the
    suffix behind them is whole, and the others of the forward side. The position
    is the middle, or where that reaches many shards, the one that reaches fewest."""

    def deal(length: int, word: str, turned: str) -> list[tuple]:
        def cost(t: int) -> tuple[int, int]:
            return (len(_reach(borders[0], length, word[:t])) if t < length else 0) + (len(_reach(borders[1], length, turned[: length - t])) if t else 0), t

        t = 0 if not borders[0] else length // 2
        if borders[0] and cost(t)[0] > 3:
            t = min(map(cost, (0, *range(max(1, t - 32), min(length, t + 32)), length)))[1]
        out = [(0, s, t, length) for s in _reach(borders[0], length, word[:t])] if t < length else []
        return out + ([(1, s, 0, t) for s in _reach(borders[1], length, turned[: length - t])] if t else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word, n in zip(pdf["word"], pdf["n"], strict=True):
                size, turned = len(word), word[::-1]
                rows.append((0, bisect_right(borders[0], (size, word)), False, word, n, size, 0, 0))
                if borders[0]:
                    rows.append((1, bisect_right(borders[1], (size, turned)), False, word, n, size, 0, 0))
                for length in (size, size + 1):
                    rows += [(side, shard, True, word, n, length, a, b) for side, shard, a, b in deal(length, word, turned)]
            yield pd.DataFrame(rows, columns=["side", "shard", "asks", "word", "n", "length", "first", "last"])

    return words.mapInPandas(run, "side int, shard int, asks boolean, word string, n long, length int, first int, last int")


def _best(of: np.ndarray, names: np.ndarray, near_n: np.ndarray, near: np.ndarray) -> pd.DataFrame:
    """Of some links, per word ``of``: their number, and the near word of largest n."""
    order = np.lexsort((near, -near_n, of))
    of, near_n, near = of[order], near_n[order], near[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return pd.DataFrame({"word": names[of[first]], "n_near": np.diff(np.append(first, len(of))), "near_n": near_n[first], "near": near[first]})


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard, members before queries. A shard's members are held,
    its queries stream by. Both ends of an insertion are told, as only the shorter
    word asks for it."""
    at, members, built = None, {}, {}
    for pdf in batches:
        for key, part in pdf.groupby(["side", "shard"], sort=False):
            if key != at:
                at, members, built = key, {}, {}
            inside, asked = part[~part["asks"]], part[part["asks"]]
            for length, of in inside.groupby("length"):
                words, counts = members.setdefault(length, ([], []))
                words += of["word"].tolist()
                counts += of["n"].tolist()
            for (length, _), of in asked.groupby(["length", asked["word"].str.len()]):
                if length not in members:
                    continue
                if length not in built:
                    built[length] = Words(*members[length])
                index, words, n = built[length], np.array(of["word"].tolist()), of["n"].to_numpy()
                q, found = index.near(words, of["first"].to_numpy(), of["last"].to_numpy())
                if len(q):
                    yield _best(q, words, index.counts[found], index.words[found])
                    if words.dtype != index.words.dtype:
                        yield _best(found, index.words, n[q], words[q])


def near_words(words: DataFrame, put) -> DataFrame:
    """(word, n_near, near, near_n) of words that have near ones: two words are near
    if exactly one inserted, deleted or replaced code point parts them. ``words``:
    (word, n), words different and not empty. Exact; no pair is written, as each
    shard counts its links and keeps the best one per word."""
    total = words.count()
    shards = max(1, min(SHARDS, -(-total // SHARD_WORDS)))
    dealt = put(_routes(words, _borders(words, shards, total)), "variant-routes")
    sorted_ = dealt.repartition(2 * shards, "side", "shard").sortWithinPartitions("side", "shard", "asks")
    links = sorted_.mapInPandas(_search, "word string, n_near long, near_n long, near string")
    top = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    best = links.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top"))
    return best.select("word", "n_near", F.col("top.near").alias("near"), (-F.col("top.m")).alias("near_n"))


def _roots(formed: DataFrame, put) -> DataFrame:
    """(word, root): the last form that forms lead to. Each form has ten times the
    occurrences, so chains are as long as the largest count has digits at most;
    every round doubles the steps taken."""
    most = formed.agg(F.max("form_n")).first()[0]
    found = formed.select("word", F.col("form").alias("root"))
    for _ in range((len(str(most)) if most else 0).bit_length()):
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = put(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return found


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n; words are
    different). ``form`` is the near word of largest n, ties by code points, where
    that is at least ``factor`` (2 or more) times the word's own n, else null;
    ``root`` is where forms lead, the word itself without one. Empty words and null
    ones are left out, other columns are not read, and no words give no rows."""
    with scratch(words.sparkSession) as put:
        own = put(words.where(F.length("word") > 0).select("word", F.col("n").cast("long").alias("n")), "variant-words")
        near = near_words(own, put)
        large: Column = F.col("near_n") >= factor * F.col("n")
        met = put(
            own.join(near, "word", "left").select(
                "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("near")).alias("form"), F.when(large, F.col("near_n")).alias("form_n")
            ), "variant-forms",
        )
        roots = _roots(met.where("form IS NOT NULL"), put)
        out = met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return stage(out, "variants")
