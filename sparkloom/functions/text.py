"""Tokens, redaction, lint and hashes of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning.
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "was", "are")


def tokens(c: Column, least: int = 3) -> Column:
    """Lower-case ASCII words of ``least`` characters or more, without stop words."""
    words = F.split(F.lower(c), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def letter_tokens(c: Column) -> Column:
    """Words of letters and digits of any script, distinct, two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))


def redact(c: Column) -> Column:
    """Credentials and addresses masked."""
    c = F.regexp_replace(c, r"(?i)(password|token|secret|api_?key)([\"']? *[:=] *[\"']?)[A-Za-z0-9+/_.=-]{6,}", "$1$2***")
    c = F.regexp_replace(c, "AKIA[A-Z0-9]{16}", "AKIA***")
    # a run of letters is tried once, at its start or where the last match ended
    return F.regexp_replace(c, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "***@***")


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of values in a fixed order; nulls differ from empty text."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns)), 256)


def title_lint(c: Column) -> dict[str, Column]:
    """The cleaned title and the rules that changed it, in order."""
    rules = {
        "R1": lambda x: F.trim(F.regexp_replace(x, " +", " ")), "R2": lambda x: F.regexp_replace(x, "!+", ""),
        "R3": lambda x: F.regexp_replace(x, r"([0-9]) (oz|lb)\b", "$1$2"), "R4": lambda x: F.regexp_replace(x, "[,;-]+$", ""),
        "R5": lambda x: F.regexp_replace(x, "(?i)^(new|sale) ", ""),
    }
    applied, now = [], c
    for name, rule in rules.items():
        then = rule(now)
        applied.append(F.when(then != now, F.lit(name)))
        now = then
    return {"title": now, "rules": F.concat_ws(",", *applied)}
