"""Ordered refusals, gates of a candidate against a baseline, scores of fields, costs rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the share of the baseline's mean that a measure with a floor may fall to.
FLOOR = 0.9


def first_refusal(checks: dict[str, Column]) -> Column:
    """The code of the first check in the given order that refuses, else null. A
    check that is null does not refuse; say ``isNull`` where missing facts do."""
    return F.coalesce(*(F.when(refuses, code) for code, refuses in checks.items()))


def compare_arms(rows: DataFrame, scope: str, arm: Column, gains: dict[str, Column], floors: dict[str, Column],
                 errors: dict[str, Column]) -> DataFrame:
    """(scope, name, baseline, threshold, actual, margin, passed): one row for each
    measure of each scope. ``arm`` is true for rows of the candidate, false for the
    baseline, null for neither.

    ``gains`` must rise above the baseline by more than the joint margin of both
    means, the root of the summed squares of 1.96 standard errors; equal means
    never pass. ``floors`` may fall to FLOOR of the baseline. ``errors`` are
    conditions that no candidate row may meet. Null measures of a row are left
    out; a scope without one of the arms passes no gain and no floor. One
    aggregate, combined before it is shuffled; a scope is one row of sums.
    """
    means = gains | floors
    base = rows.select(F.col(scope).alias("scope"), arm.alias("a"), *(c.cast("double").alias(f"m_{k}") for k, c in means.items()), *(c.alias(f"e_{k}") for k, c in errors.items()))
    sums = []
    for k in means:
        for name, side in (("b", ~F.col("a")), ("c", F.col("a"))):
            v = F.when(side, F.col(f"m_{k}"))
            sums += [F.avg(v).alias(f"{name}_{k}"), (1.96 * F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{name}u_{k}")]
    for k in errors:
        sums += [F.count_if(F.col(f"e_{k}") & ~F.col("a")).cast("double").alias(f"b_{k}"), F.count_if(F.col(f"e_{k}") & F.col("a")).cast("double").alias(f"c_{k}")]
    one = base.where("a IS NOT NULL").groupBy("scope").agg(*sums)
    none, zero = F.lit(None).cast("double"), F.lit(0.0)

    def check(k: str) -> Column:
        b, c = F.col(f"b_{k}"), F.col(f"c_{k}")
        if k in errors:
            at, margin, ok = zero, none, c == 0
        elif k in floors:
            at, margin = b * FLOOR, none
            ok = c >= at - 1e-9
        else:
            u = lambda s: F.coalesce(F.col(f"{s}u_{k}"), zero)
            at, margin = b, F.sqrt(u("b") * u("b") + u("c") * u("c"))
            ok = c - b - margin > 1e-9
        return F.struct(F.lit(k).alias("name"), b.alias("baseline"), at.alias("threshold"), c.alias("actual"), margin.alias("margin"), F.coalesce(ok, F.lit(False)).alias("passed"))

    return one.select("scope", F.explode(F.array(*(check(k) for k in [*errors, *gains, *floors]))).alias("x")).select("scope", "x.*")


def field_status(expected: Column, found: Column) -> Column:
    """How a found value compares with the one that is expected; null is none."""
    return (
        F.when(expected.isNull(), F.when(found.isNull(), "unavailable").otherwise("unexpected"))
        .when(found.isNull(), "missing").when(expected == found, "correct").otherwise("wrong")
    )


def identity_verdict(code: tuple[Column, Column], title: tuple[Column, Column], variant: tuple[Column, Column]) -> Column:
    """Whether a page is the one that is expected; pairs are (expected, found).
    Codes decide first, then titles; a found title that is a part of the expected
    one identifies nothing. A match of another variant is a wrong one."""
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    matched = F.when(both(variant) & (variant[0] != variant[1]), "wrong_variant").otherwise("correct_match")
    by_title = F.when(F.contains(title[1], title[0]), matched).when(F.contains(title[0], title[1]), "unidentified").otherwise("wrong_product")
    return F.when(both(code), F.when(code[0] == code[1], matched).otherwise("wrong_product")).when(both(title), by_title).otherwise("unidentified")


def roll_up_costs(scopes: DataFrame, domain: str) -> DataFrame:
    """Costs of domains from those of their scopes: (samples, base_ms, cand_ms,
    base_requests, cand_requests, base_minutes, cand_minutes, basis) by scope.
    Times are means weighted by samples, requests and minutes are sums; the basis
    is that of all scopes or ``mixed``. Null figures of a scope count as zero."""
    n = F.sum("samples")
    s = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    mean = lambda c: F.when(n > 0, F.round(s(F.col(c) * F.col("samples")) / n, 1)).otherwise(0.0)
    total = scopes.groupBy(domain).agg(
        n.alias("samples"), F.count("*").alias("scopes"), mean("base_ms").alias("base_ms"), mean("cand_ms").alias("cand_ms"),
        F.sum("base_requests").alias("base_requests"), F.sum("cand_requests").alias("cand_requests"),
        F.round(s(F.col("base_minutes")), 1).alias("base_minutes"), F.round(s(F.col("cand_minutes")), 1).alias("cand_minutes"),
        F.when(F.min("basis") == F.max("basis"), F.min("basis")).otherwise("mixed").alias("basis"),
    )
    saved = F.round(F.col("base_minutes") - F.col("cand_minutes"), 1)
    return total.withColumns({"saved": saved, "bounded": F.col("cand_minutes") <= F.col("base_minutes")})
