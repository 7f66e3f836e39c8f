"""Quality rules as a ledger of bits: measured and judged once, weighed by any policy afterwards.

``measure`` reads every text once and returns counts. ``ledger`` turns them into
one long whose bit k is set where rule k fails. A policy is a mask over these
bits, so a new version of it, or leaving one rule out, reads the ledger and no text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Words of a window that counts as repeated.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Measurements of a text, all long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """``fails`` gets a column of a measurement by its name."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Bit k of the ledger is rule k. Rules are only ever added at the end, as old ledgers keep their bits.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_lines") >= 10) & (100 * m("n_dup_lines") > 50 * m("n_lines"))),
    Rule("capitals", lambda m: 10 * m("n_capitals") > 6 * m("n_letters")),
    Rule("few_letters", lambda m: 2 * m("n_letters") < m("word_chars")),
    Rule("long_words", lambda m: m("word_chars") > 30 * m("n_words")),
)

#: Version -> the rules that it enforces.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "capitals", "few_letters"),
    "v2": tuple(r.name for r in RULES),
}


def bit(rule: str) -> int:
    return 1 << [r.name for r in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more. Windows
    of 1, 2, 4, ... words get numbers by sorting pairs of shorter ones, so equal
    numbers are equal words and nothing rests on a hash. ``width`` is a power of two."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    size, kinds = 1, len(seen)
    while size < width:
        ids = ids[:-size] * kinds + ids[size:]
        kinds, ids = (u := np.unique(ids, return_inverse=True))[0].size, u[1]
        if kinds == ids.size:
            return 0
        size *= 2
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges[starts] += 1
    edges[starts + width] -= 1
    return int((np.cumsum(edges) > 0).sum())


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_BLANK, _UPPER, _LOWER = _bytes(" \t\n\v\f\r"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz")


def counts(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of COUNTS. Characters are counted
    from a histogram of bytes: a code point is a byte that continues none, and
    those beyond ASCII count as letters. ``bytes.split`` parts at the six blanks."""
    bins = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    beyond, upper = int(bins[192:].sum()), int(bins[_UPPER].sum())
    words, filled = text.split(), [line for line in text.split(b"\n") if line.split(None, 1)]
    return (
        len(words), int(bins[:128].sum()) + beyond - int(bins[_BLANK].sum()), int(bins[_bytes(SYMBOLS)].sum()),
        len(filled), len(filled) - len(set(filled)), repeated_words(words), upper + int(bins[_LOWER].sum()) + beyond, upper,
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the columns of COUNTS) for every row, by one pass over whole texts and
    without a shuffle. A null text counts as empty, an empty one gives zeros;
    null and repeated ids and repeated rows stay rows of their own; other columns
    are not read; an empty table gives an empty one."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([counts(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found.reshape(-1, len(COUNTS)).T)], ["id", *COUNTS])

    whole = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").cast("binary").alias("t"))
    return whole.mapInArrow(run, f"id {key}, " + ", ".join(f"{c} long" for c in COUNTS))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the columns of COUNTS, failed long): bit k of ``failed`` is set where
    rule k of RULES fails. Rows as those of ``measure``."""
    bits = [F.when(r.fails(F.col), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failed", total)


def passes(failed: Column, policy: str, without: tuple[str, ...] = ()) -> Column:
    """True where no rule of the policy fails, those of ``without`` left out."""
    return failed.bitwiseAND(F.lit(mask(policy) & ~sum(map(bit, without)))) == 0


def ablation(judged: DataFrame) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_alone, n_kept, n_kept_without) for every
    policy and each of its rules, from the bits of a ledger alone. Rows are counted
    by their bits first, of which there are at most 2 to the number of rules; the
    rest works on these counts. ``n_alone``: documents that only this rule drops;
    ``n_kept_without``: those kept if it were left out. An empty ledger gives zeros."""
    kinds = judged.groupBy("failed").agg(F.count("*").alias("n"))
    rows = [(p, r, mask(p), bit(r)) for p, names in POLICIES.items() for r in names]
    asked = judged.sparkSession.createDataFrame(rows, "policy string, rule string, all long, own long")
    hit = F.coalesce(F.col("failed"), F.lit(0)).bitwiseAND(F.col("all"))

    def n(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("long")

    met = asked.join(F.broadcast(kinds), F.lit(True), "left")
    return met.groupBy("policy", "rule").agg(
        n(F.lit(True)).alias("n_docs"), n(hit.bitwiseAND(F.col("own")) != 0).alias("n_failed"), n(hit == F.col("own")).alias("n_alone"),
        n(hit == 0).alias("n_kept"), n(hit.bitwiseAND(F.bitwise_not("own")) == 0).alias("n_kept_without"),
    )


def rule_filter(docs: DataFrame, policy: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns. Each text is
    judged in its own row under a row number of no meaning beyond this call, so
    null and repeated ids and columns of any name do no harm."""
    names = docs.columns
    packed = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(docs[c] for c in names)).alias("doc")), "rules")
    judged = ledger(packed.select("row", F.col("doc")[text_col].alias("text")), "row", "text")
    kept = judged.where(passes(F.col("failed"), policy)).select(F.col("id").alias("row"))
    return packed.join(kept, "row").select(*(F.col("doc")[c].alias(c) for c in names))
