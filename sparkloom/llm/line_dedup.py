"""Line dedup: exact set-similarity join of lines, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stage, text_or_empty

#: White space within a line besides the blank.
ODD = "\t\x0b\x0c\r"
#: Least Jaccard similarity, as a fraction.
NUM, DEN = 4, 5
#: Buckets of token hashes whose tokens are counted.
BUCKET_BITS = 16
HALF = 1 << (BUCKET_BITS - 1)
#: Tokens up to which a line keeps them all in the first pass.
SHORT = 24
#: Entries up to which a table of ids with line numbers is broadcast; a larger one is joined by shuffles.
BROADCAST_LINES = 1_000_000
NO_ID = -(2**63)
#: Longs of parities by which pairs of lines are ruled out, a power of two.
PARITIES = 2


def _blanks(text: Column) -> Column:
    """Text with every white space of a line as a blank, so that lines part at a
    plain character."""
    odd = F.lit(False)
    for c in ODD:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, ODD, " " * len(ODD))).otherwise(text)


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = True) -> list[Column]:
    """Id and hash of the text, which only rows that are the same document share;
    where no id repeats, 0 does for the hash."""
    h = F.xxhash64(text_or_empty(docs, text_col)) if hashed else F.lit(0).cast("long")
    return [F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), h.alias("h")]


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether two rows share an id. Where none do, no hash of a text goes along
    with every token of it."""
    ids = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] not in (None, 1)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " ", -1), "")


def _lines(docs: DataFrame, id_col: str, text_col: str, hashed: bool) -> DataFrame:
    """(id, h, no, w) of every line that has words, with its words."""
    rows = docs.select(*row_key(docs, id_col, text_col, hashed), F.posexplode_outer(F.split(_blanks(text_or_empty(docs, text_col)), "\n", -1)).alias("no", "line"))
    return rows.where(F.trim("line") != "").select("id", "h", "no", _words(F.col("line")).alias("w"))


def _hashed_words() -> Column:
    return F.transform("w", lambda x: F.xxhash64(x))


def _runs(width: int) -> Column:
    """Every run of ``width`` words of the array ``w`` as a struct; a shorter line
    is one run of all its words, the others null."""
    size = F.size("w")
    runs = F.arrays_zip(*(F.slice("w", F.lit(1 + k), F.greatest(size - width + 1, F.lit(0))).alias(f"w{k}") for k in range(width)))
    short = F.array(F.struct(*(F.get("w", F.lit(k)).alias(f"w{k}") for k in range(width))))
    return F.when(size >= width, runs).otherwise(short)


def _tokens(width: int) -> Column:
    """The distinct tokens of the hashed words ``w``."""
    return F.array_distinct(F.transform(_runs(width), lambda r: F.xxhash64(*(r[f"w{k}"] for k in range(width)))))


def _bucket(h: Column) -> Column:
    """Bucket of a hash; they are in the order of the hashes."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(NO_ID)), 64 - BUCKET_BITS).cast("int")


def _posts(n: Column) -> Column:
    """How many of n tokens are posted."""
    return (n - F.floor((NUM * n + DEN - 1) / DEN) + 1).cast("int")


def _classes(lines: DataFrame, width: int) -> DataFrame:
    """(line, n, some) of each class of lines with the same words: its first line,
    the number of its tokens and in order all of them where the line is short,
    else those in the lower half of the hash space."""
    told = lines.select(F.struct("id", "no", "h").alias("line"), F.xxhash64("w").alias("c1"), F.hash("w").alias("c2"), _hashed_words().alias("w"))
    told = told.select("line", "c1", "c2", F.sort_array(_tokens(width)).alias("tokens"))
    n = F.size("tokens")
    some = F.when(n <= SHORT, F.col("tokens")).otherwise(F.filter("tokens", lambda x: x < 0))
    classed = told.select("line", "c1", "c2", n.alias("n"), some.alias("some")).groupBy("c1", "c2", "n")
    return classed.agg(F.min("line").alias("line"), F.any_value("some").alias("some")).select("line", "n", "some")


def _levels(tokens: DataFrame, first: int) -> DataFrame:
    """One row: for each of the HALF buckets from ``first`` its level, 0 where the
    rows of ``tokens`` (token) that fall there are at most a tenth above the mean of
    these buckets, and one more for each further 19 %. The table has a fixed
    size, whatever is counted; the tokens that stand out of their buckets are those
    with a large share of all."""
    counts = tokens.groupBy(_bucket(F.col("token")).alias("b")).agg(F.count("*").alias("n"))
    every = tokens.sparkSession.range(first, first + HALF, numPartitions=1).select(F.col("id").cast("int").alias("b"))
    both = every.join(F.broadcast(counts), "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"))
    both = both.agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("ns"), F.sum("n").alias("all"))
    over = lambda n: F.greatest(F.lit(0), F.ceil(4 * F.log2((n + 1) * HALF / (1.1 * (F.col("all") + 1)))))
    return both.select(F.transform("ns", lambda x: over(x["n"]).cast("tinyint")).alias("levels"))


def _level(levels: Column, h: Column) -> Column:
    return F.get(levels, _bucket(h))


def _posted(whole: DataFrame) -> DataFrame:
    """``whole`` with the number ``n`` of its sorted ``tokens`` and those it posts
    as ``prefix``, those of level 0 first and the others by their levels. Only
    lines with too few of level 0 are ordered as a whole."""
    n, k = F.size("tokens"), _posts(F.size("tokens"))
    plain = F.filter("tokens", lambda x: _level(F.col("levels"), x) == 0)
    ordered = F.sort_array(F.transform("tokens", lambda x: F.struct(_level(F.col("levels"), x).alias("l"), x.alias("x"))))
    prefix = F.when(F.size("plain") >= k, F.slice("plain", F.lit(1), k)).otherwise(F.transform(F.slice(ordered, F.lit(1), k), lambda x: x["x"]))
    return whole.select("*", plain.alias("plain")).select("*", n.alias("n"), prefix.alias("prefix"))


def _parities(tokens: Column) -> Column:
    """PARITIES longs: a bit for each place that a hash may name, set if an odd
    number of the tokens name it."""
    none = F.lit(0).cast("long")

    def parity(k: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
        here = lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(PARITIES - 1) == k
        return F.aggregate(tokens, none, lambda a, x: a.bitwiseXOR(F.when(here(x), bit(x)).otherwise(none)))

    return F.array(*(parity(k) for k in range(PARITIES)))


def _near(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """The pairs (x, y) of lines of ``told`` (line, n, p), their numbers of tokens and
    parities, that may be similar: where two sets differ by few tokens, their
    parities differ in no more places. No similar pair is lost, and no tokens
    are sent along with each pair."""
    a, b = told.toDF("x", "nx", "px"), told.toDF("y", "ny", "py")
    apart = sum((F.bit_count(F.col("px")[k].bitwiseXOR(F.col("py")[k])) for k in range(PARITIES)), F.lit(0))
    return pairs.join(a, "x").join(b, "y").where((NUM + DEN) * apart <= (DEN - NUM) * (F.col("nx") + F.col("ny"))).select("x", "y")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose token sets reach the similarity."""
    a, b = sets.select(F.col("line").alias("x"), F.col("tokens").alias("tx")), sets.select(F.col("line").alias("y"), F.col("tokens").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    found = pairs.join(a, "x").join(b, "y").where(DEN * both >= NUM * (F.size("tx") + F.size("ty") - both))
    return found.select("x", "y")


def _by_row(table: DataFrame, docs: DataFrame, entries: int) -> DataFrame:
    """Inner join of rows with their keys and the table of keys; the table is
    broadcast only where its counted entries are few."""
    return docs.join(F.broadcast(table) if entries <= BROADCAST_LINES else table, ["id", "h"])


def _shared(posts: DataFrame, levels: DataFrame) -> DataFrame:
    """``posts`` (token, id, no, h, ...) of the tokens that two or more classes
    post, with the number of its posts and the least id among them.

    Tokens of level 0 hold little more than the mean of a bucket each, so a
    token's posts meet in one task. Those above are counted with partial sums
    and joined back, where Spark can split a token over tasks.
    """
    marked = posts.withColumn("levels", levels.scalar())
    marked = marked.select(*posts.columns, (_level(F.col("levels"), F.col("token")) > 0).alias("high"))
    group = Window.partitionBy("token")
    low = marked.where("not high").withColumns({"size": F.count("*").over(group), "low": F.min("id").over(group)}).where("size > 1")
    sizes = marked.where("high").groupBy("token").agg(F.count("*").alias("size"), F.min("id").alias("low")).where("size > 1")
    top = marked.where("high").join(sizes, "token")
    columns = [*posts.columns, "size", "low"]
    return low.select(*columns).unionByName(top.select(*columns))


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, hashed: bool | None = None) -> DataFrame:
    """(id, h, kept): for each row, by ``row_key``, with a line that stays, the
    numbers of its lines that stay, from 0 and in order. Lines without words are
    not counted. ``hashed`` is that of ``row_key``, by default whether ids repeat.

    A line's tokens are its distinct runs of ``width`` words, or all its words
    where they are fewer, ordered by how many classes share their bucket of hashes.
    A line goes if an earlier line, by id, line number and hash of the text, has
    a Jaccard similarity of NUM/DEN or more to it, whether that one stays or not.
    Lines with the same words are one class, which its first line stands for. Of
    n tokens in the order of rarity, n - ceil(s*n) + 1 are posted: two similar
    sets share one of them. Length and position of a shared token bound the
    overlap; what passes is verified on all tokens of both lines.

    Rare tokens come first, by their hashes, so a long line posts from the lower
    half of the hash space, and only its tokens there are kept; what is common
    there is counted on all lines. The few lines with too few rare ones among them are
    read again as a whole, and what is common in the upper half is counted on them
    and the short lines, as no others post there.

    So that large groups of near copies cost no pairs, every class is first
    compared with the earliest class of each of its tokens only; just those
    that no such comparison removes go on to meet all earlier ones. Each time
    texts are read again for the lines of the pairs alone.

    Rows that share id and text are one document and lose the same lines; rows
    that share only the id, or have none, are documents of their own. Null ids
    come before all others. Null text counts as empty and has no lines; other
    columns are ignored, whatever their names; no rows give no rows. Runs are
    told apart by 64-bit hashes.
    """
    c, line = F.col, F.struct("id", "no", "h")
    hashed = ids_repeat(docs, id_col) if hashed is None else hashed

    def possible(na: str, ia: str, nb: str, ib: str) -> Column:
        """Length and position filter in whole numbers."""
        na, ia, nb, ib = map(c, (na, ia, nb, ib))
        most = F.least(na - ia, nb - ib)
        return (DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)) & ((NUM + DEN) * most >= NUM * (na + nb))

    def sets(put, wanted: DataFrame) -> DataFrame:
        """(line, tokens) of the lines ``wanted`` (x), from their texts."""
        wanted = put(wanted.groupBy("x.id", "x.h").agg(F.collect_list("x.no").alias("nos")), "wanted")
        entries = wanted.agg(F.sum(F.size("nos"))).first()[0] or 0
        texts = docs.select(*row_key(docs, id_col, text_col, hashed), text_or_empty(docs, text_col).alias("text"))
        found = _by_row(wanted, texts, entries).select("id", "h", F.split(_blanks(c("text")), "\n", -1).alias("all"), F.explode("nos").alias("no"))
        found = found.select(line.alias("line"), _words(F.get("all", c("no"))).alias("w"))
        return put(found.select("line", _hashed_words().alias("w")).select("line", _tokens(width).alias("tokens")), "sets")

    def similar(put, pairs: DataFrame) -> DataFrame:
        """(x) of the pairs (x, y) whose token sets reach the similarity."""
        met = pairs.select(F.explode(F.array("x", "y")).alias("x")).distinct()
        tokens = sets(put, met)
        told = put(tokens.select("line", F.size("tokens").alias("n"), _parities(c("tokens")).alias("p")), "parities")
        near = put(_near(pairs, told), "near")
        return put(_similar(near, tokens).select("x").distinct(), "gone")

    def prefixes(put, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(line, n, prefix) of the classes and the levels by bucket."""
        low = put(_levels(classes.select(F.explode("some").alias("token")).where("token < 0"), 0), "low")
        # a column of its own as subqueries may not stand in a lambda; the optimizer puts it back as a constant
        long = classes.where(c("n") > SHORT).select("line", "n", "some", low.scalar().alias("levels"))
        long = long.select("line", "n", F.filter("some", lambda x: _level(c("levels"), x) == 0).alias("plain"))
        k = _posts(c("n"))
        long = put(long.select("line", "n", F.when(F.size("plain") >= k, F.slice("plain", F.lit(1), k)).alias("prefix")), "long")
        few = put(long.where("prefix is null").select(c("line").alias("x")), "few")
        whole = classes.where(c("n") <= SHORT).select("line", c("some").alias("tokens"))
        if not few.isEmpty():
            whole = whole.unionByName(sets(put, few))
        high = put(_levels(whole.select(F.explode("tokens").alias("token")).where("token >= 0"), HALF), "high")
        levels = put(low.crossJoin(high.select(c("levels").alias("upper"))).select(F.concat("levels", "upper").alias("levels")), "levels")
        whole = _posted(whole.select("line", F.sort_array("tokens").alias("tokens"), levels.scalar().alias("levels")))
        return long.where("prefix is not null").unionByName(whole.select("line", "n", "prefix")), levels

    with scratch(docs.sparkSession) as put:
        with scratch(docs.sparkSession) as early:
            with scratch(docs.sparkSession) as first:
                classes = first(_classes(_lines(docs, id_col, text_col, hashed), width), "classes")
                every = put(classes.select("line"), "lines")
                classes, levels = prefixes(first, classes)
                classes, levels = early(classes, "prefixes"), early(levels, "levels")

            posts = classes.select("line.*", "n", F.posexplode("prefix").alias("i", "token")).select("token", "id", "no", "h", "n", "i")
            shared = early(_shared(posts, levels), "shared")
            first = shared.where("id = low").groupBy("token").agg(F.min(F.struct("id", "no", "h", "n", "i")).alias("f"))
            first = first.select("token", F.struct("f.id", "f.no", "f.h").alias("y"), c("f.n").alias("ny"), c("f.i").alias("iy"))
            led = shared.join(first, "token").select("token", line.alias("x"), c("n").alias("nx"), c("i").alias("ix"), "y", "ny", "iy", "size")
            led = put(led.where("x <> y"), "led")

        pairs = put(led.where(possible("nx", "ix", "ny", "iy")).select("x", "y").distinct(), "pairs")
        with scratch(docs.sparkSession) as early:
            gone = put(similar(early, pairs), "gone")
        others = led.where("size > 2")  # of the tokens that more than the first and one other class post
        a = others.join(gone, "x", "left_anti").select("token", "x", c("nx").alias("na"), c("ix").alias("ia"))
        b = others.select("token", c("x").alias("y"), c("nx").alias("nb"), c("ix").alias("ib"))
        rest = a.join(b, "token").where((c("y") < c("x")) & possible("na", "ia", "nb", "ib"))
        rest = put(rest.select("x", "y").distinct(), "rest")
        with scratch(docs.sparkSession) as early:
            gone = gone.union(put(similar(early, rest), "gone"))
        stay = every.join(gone, c("line") == c("x"), "left_anti")
        return stage(stay.groupBy("line.id", "line.h").agg(F.array_sort(F.collect_set("line.no")).alias("kept")), "kept")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, hashed: bool | None = None) -> DataFrame:
    """(id_col, id, h, worded, kept) for every row of ``docs``: its key by
    ``row_key``, the numbers of its lines with words and of those that stay, as
    ``kept_lines`` finds them."""
    hashed = ids_repeat(docs, id_col) if hashed is None else hashed
    lines = F.split(text_or_empty(docs, text_col), "\n", -1)
    worded = F.array_compact(F.transform(lines, lambda x, k: F.when(has_words(x), k)))
    rows = docs.select(docs[id_col].alias(id_col), *(k.alias(f"{n}_") for k, n in zip(row_key(docs, id_col, text_col, hashed), "ih", strict=True)), worded.alias("worded"))
    kept = kept_lines(docs, id_col, text_col, width, hashed).withColumnsRenamed({"id": "i_", "h": "h_"})
    return rows.join(kept, ["i_", "h_"], "left").select(
        id_col, F.col("i_"), F.col("h_"), "worded", F.coalesce("kept", F.array().cast("array<int>")).alias("kept")
    )


def has_words(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with the lines that ``kept_lines`` removes cut from the text, and
    without the documents that lose all lines that had words. Lines without
    words stay; documents that have no words stay as they are, null text too.
    Repeated rows each lose the same lines, so a document and its exact copies
    with the same id stay or go together; no rows give no rows. Other columns
    are returned unchanged, whatever their names."""
    hashed = ids_repeat(docs, id_col)
    report = line_report(docs, id_col, text_col, width, hashed)
    cut = report.select("i_", "h_", F.array_except("worded", "kept").alias("out"), (F.size("kept") == 0).alias("none"))
    cut = stage(cut.where(F.size("out") > 0).dropDuplicates(["i_", "h_"]), "cut")
    entries = cut.agg(F.sum(F.size("out"))).first()[0] or 0
    ident, h = row_key(docs, id_col, text_col, hashed)
    kept = docs.select(F.struct(*docs.columns).alias("row"), ident.alias("i_"), h.alias("h_"))
    rows = kept.join(F.broadcast(cut) if entries <= BROADCAST_LINES else cut, ["i_", "h_"], "left").where(~F.coalesce("none", F.lit(False)))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    lines = F.transform(F.split(text, "\n", -1), lambda x, k: F.when(~F.array_contains("out", k), x))
    new = F.when(F.col("out").isNull(), F.col("row")[text_col]).otherwise(F.array_join(F.array_compact(lines), "\n"))
    return rows.select(*((new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
