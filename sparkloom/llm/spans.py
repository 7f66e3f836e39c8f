"""Spans of pattern matches, with built-in functions only. Spans are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256
#: Spans that are replaced at a time.
GROUP = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body, or a
    lambda within it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def running_sums(xs: Column) -> Column:
    """Sum of the entries before each entry of an array of int. Chunks keep the
    work linear in the length of long arrays."""

    def of(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        parts = F.transform(chunks, lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))
        return let(parts, lambda parts: let(F.transform(parts, _sum), lambda totals: F.flatten(F.transform(parts, lambda part, c: within(part, totals, c)))))

    def within(part: Column, totals: Column, c: Column) -> Column:
        start = F.struct(_sum(F.slice(totals, F.lit(1), c)).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, start, step, lambda a: a["out"])

    return let(xs, of)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of the leftmost non-overlapping matches of a
    pattern that matches no empty string."""

    def spans(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
        span = lambda a, s: F.struct(a.alias("start"), (a + F.length(s)).alias("end"), s.alias("s"))

        def placed(gaps: Column) -> Column:
            before = running_sums(F.zip_with(gaps, found, lambda g, s: g + F.length(s)))
            return F.zip_with(F.zip_with(before, gaps, lambda a, g: a + g), found, span)

        return F.when(F.size(found) > 0, let(gaps, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,s:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def keyed(kind: int, spans: Column) -> Column:
    """array<struct<start, kind, end>>, sortable by start and then kind."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return let(others, lambda others: F.filter(spans, lambda x: ~F.exists(others, lambda o: (x["start"] < o["end"]) & (o["start"] < x["end"]))))


def joined(spans: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    table = F.array(*map(F.lit, names))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(table, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def free(rows: DataFrame, keys: list[str], rank: Column, ranks: int) -> DataFrame:
    """The rows with a span ``p`` of a rank from 1 on that overlap no span of their
    keys of a lower rank. Ranks are below ``ranks``. Spans are swept by start from
    both sides, so that work does not grow with their pairs."""
    start, own = F.col("p.start"), F.col("_rank")
    before = Window.partitionBy(*keys).orderBy(start).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy(*keys).orderBy(start.desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lower = range(ranks - 1)
    swept = rows.withColumn("_rank", rank).select(
        "*", *(F.max(F.when(own <= r, F.col("p.end"))).over(before).alias(f"_e{r}") for r in lower), *(F.min(F.when(own <= r, start)).over(behind).alias(f"_s{r}") for r in lower)
    )
    ends, starts = (F.get(F.array(*(f"_{c}{r}" for r in lower)), own - 1) for c in "es")
    open_ = (own > 0) & (F.coalesce(ends, F.lit(0)) <= start) & (F.coalesce(starts, F.col("p.end")) >= F.col("p.end"))
    return swept.where(open_).select(*rows.columns)


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spans): for each key the spans ``p``, sorted, those that begin within
    earlier ones united with them under the kind of the first."""
    order = Window.partitionBy(*keys).orderBy("p.start", "p.kind")
    last = F.max("p.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, "p", F.coalesce((F.col("p.start") >= last).cast("int"), F.lit(1)).alias("fresh"))
    islands = marked.select(*keys, "p", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("island"))
    united = islands.groupBy(*keys, "island").agg(
        F.min("p.start").alias("start"), F.min_by("p.kind", F.struct("p.start", "p.kind")).alias("kind"), F.max("p.end").alias("end")
    )
    return united.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def redact(text: Column, spans: Column, names: tuple[str, ...]) -> Column:
    """Text with each of the disjoint, sorted spans replaced by its kind in
    brackets. Every GROUP spans work on the part of the text that they lie in, as
    finding a place takes time in proportion to what lies before it."""
    table, n = F.array(*map(F.lit, names)), F.size(spans)
    groups = F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int"))
    end = lambda k: F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
    stop = lambda g: F.when((g + 1) * GROUP < n, end((g + 1) * GROUP)).otherwise(F.length(text))
    cut = F.transform(groups, lambda g: F.struct(
        end(g * GROUP).alias("at"), F.substring(text, end(g * GROUP) + 1, stop(g) - end(g * GROUP)).alias("t"), F.slice(spans, g * GROUP + 1, F.lit(GROUP)).alias("x"),
    ))

    def filled(r: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            put = F.concat(a["out"], F.substring(r["t"], a["at"] - r["at"] + 1, x["start"] - a["at"]), F.lit("["), F.get(table, x["kind"]), F.lit("]"))
            return F.struct(x["end"].alias("at"), put.alias("out"))

        start = F.struct(r["at"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(r["x"], start, step, lambda a: F.concat(a["out"], F.substring(r["t"], a["at"] - r["at"] + 1, F.length(r["t"]))))

    return F.array_join(F.transform(cut, filled), "")
