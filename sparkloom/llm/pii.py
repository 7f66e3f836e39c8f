"""PII: boosted trees over candidate spans, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .secrets import KEY, _row_key
from .spans import keyed, matches, outside

KINDS = ("email", "ip", "card", "phone", "likely_email", "likely_ip", "likely_card", "likely_phone", "likely_iban", "likely_id")
# A run is tried once, at its start or where the last match ended: no start within it could do better.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
#: Generators beyond the base patterns' own matches.
TEXT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9])"
IBAN = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"
ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Words in front of a candidate that name its kind.
CUES = {
    "mail": r"(?i)mail|contact", "ip": r"(?i)\bip\b|host|addr", "card": r"(?i)card|visa|credit|karte|tarjeta|carte",
    "phone": r"(?i)phone|tel|call|mobile|fax|handy|m[oó]vil", "iban": r"(?i)iban|account|konto|cuenta|compte",
    "id": r"(?i)ssn|social|passport|\bid\b|ausweis|dni",
}
CONTEXT = 32
#: What the trees see: format and surroundings. Labels are made of checks and cue words, so neither is among them.
FEATURES = [
    "kind", "n_digits", "n_chars", "n_letters", "n_gaps", "n_runs", "plus", "paren", "at", "before_word", "before_digits", "before_mark", "before_upper",
    "line_start", "after_word", "after_end",
]


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(back, k + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add)
    return F.when(F.length(number) > 0, total % 10 == 0).otherwise(False)


def _card_ok(s: Column) -> Column:
    return F.when(F.length(digits(s)).between(16, 19), luhn_ok(digits(s))).otherwise(False)


def _phone_ok(s: Column) -> Column:
    return F.length(digits(s)).between(8, 15)


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and candidates of each row; candidates carry their text and context."""
    t = F.col("t")
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs, text_col).alias("t"))
    rows = rows.select(
        "id", *_row_key("id", t), "t", matches(t, EMAIL).alias("email"), matches(t, IP).alias("ip"),
        F.filter(matches(t, CARD), lambda x: F.length(digits(x["s"])) >= 9).alias("card"), matches(t, PHONE).alias("phone"),
        matches(t, TEXT_EMAIL).alias("g4"), matches(t, LOCAL_PHONE).alias("g7"), matches(t, IBAN).alias("g8"),
        matches(t, ID_NUMBER).alias("g9"),
    )

    def both(name, ok):
        return F.filter(name, lambda x: ok(x["s"])).alias(f"b_{name}"), F.filter(name, lambda x: ~ok(x["s"])).alias(f"c_{name}")

    rows = rows.select(
        "id", *KEY, "t", "g4", "g7", "g8", "g9", F.col("email").alias("b_email"), *both("ip", lambda s: s.rlike(OCTETS)),
        *both("card", _card_ok), *both("phone", _phone_ok),
    )
    base = F.concat(*(keyed(k, F.col(f"b_{n}")) for k, n in enumerate(KINDS[:4])))

    def candidates(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
            F.substring(t, F.greatest(F.lit(1), x["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), x["start"])).alias("before"),
            F.substring(t, x["end"] + 1, F.lit(2)).alias("after"),
        ))

    made = ((4, "g4"), (5, "c_ip"), (6, "c_card"), (7, "c_phone"), (7, "g7"), (8, "g8"), (9, "g9"))
    known = ((4, "b_email"), (5, "b_ip"), (6, "b_card"), (7, "b_phone"))
    every = F.concat(*(candidates(k, outside(F.col(c), base)) for k, c in made))
    return rows.select("id", *KEY, base.alias("base"), every.alias("open"), F.concat(*(candidates(k, F.col(c)) for k, c in known)).alias("sure"))


def _featured(c: DataFrame) -> DataFrame:
    """Feature columns of exploded candidates ``c``."""
    s, d, n = F.col("c.s"), digits(F.col("c.s")), lambda x: x.cast("double")
    cols = {
        "kind": n(F.col("c.kind")), "n_digits": n(F.length(d)), "n_chars": n(F.length(s)),
        "n_letters": n(F.length(F.regexp_replace(s, "[^A-Za-z]", ""))), "n_gaps": n(F.length(F.regexp_replace(s, r"[^\x20().\-/]", ""))),
        "plus": n(s.startswith("+")), "paren": n(s.contains("(")), "at": n(s.contains("@")),
        "n_runs": n(F.size(F.split(s, "[^0-9A-Za-z]+"))),
        "before_word": n(F.col("c.before").rlike("[A-Za-z0-9]$")), "after_word": n(F.col("c.after").rlike("^[.,-]?[A-Za-z0-9]")),
        "before_digits": n(F.length(digits(F.col("c.before")))), "before_mark": n(F.col("c.before").rlike(r"[:=(|]\x20*$")),
        "before_upper": n(F.length(F.regexp_replace(F.col("c.before"), "[^A-Z]", ""))), "line_start": n(F.col("c.before").rlike(r"(^|\n)\x20*$")),
        "after_end": n(F.col("c.after").rlike(r"^(\n|$|[.,;!?)](\s|$))")),
    }
    cols |= {f"cue_{k}": n(F.col("c.before").rlike(v)) for k, v in CUES.items()}
    return c.select("*", *(v.alias(k) for k, v in cols.items()))


def _tree(node) -> Column:
    """A fitted regression tree as nested conditions on the feature columns."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= split.threshold(), _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


#: The cue of each kind that candidates can have.
CUE_OF = {4: "mail", 5: "ip", 6: "card", 7: "phone", 8: "iban", 9: "id"}


def _fitted(parts: DataFrame, sample: int, precision: float) -> tuple[Column, dict[int, float], list[dict]] | None:
    """Score column, threshold by kind and calibration; None where no two classes
    are there. All candidates count. Matches of the base patterns and other
    candidates of each kind weigh as much as an equal share of ``sample`` at most,
    so that no frequent kind drowns a rare one; each has a part in that weight.

    Nobody has marked spans here, so labels are distant: a candidate counts as
    personal if it passes the check of its kind or a cue of its kind stands in
    front of it. Trees see neither, and are fitted on four fifths of all, by hash.
    On the rest, a kind's threshold is the lowest score, in steps of a twentieth,
    from which on the share of personal ones among the candidates that fail the
    check, as only those are to be decided, reaches ``precision``.
    """
    cue = F.coalesce(*(F.when(F.col("kind") == k, F.col(f"cue_{c}")) for k, c in CUE_OF.items()))
    both = parts.select(F.explode(F.concat(
        F.transform("sure", lambda x: F.struct(x.alias("c"), F.lit(1.0).alias("sure"))),
        F.transform("open", lambda x: F.struct(x.alias("c"), F.lit(0.0).alias("sure"))),
    )).alias("x")).select("x.c", "x.sure")
    every = _featured(both).select(*FEATURES, "sure", F.greatest("sure", cue).alias("label"), (F.pmod(F.xxhash64("c"), F.lit(5)) == 0).alias("rest"))
    rows = stage(every.groupBy(*FEATURES, "sure", "label", "rest").agg(F.count("*").alias("n")), "pii-rows")
    sizes = rows.groupBy("kind", "sure").agg(F.sum("n").alias("all"))  # at most twice for each kind
    share = max(1, sample // (2 * len(CUE_OF)))
    rows = rows.join(F.broadcast(sizes), ["kind", "sure"]).withColumn("weight", F.col("n") * F.least(F.lit(1.0), share / F.col("all")))
    train = stage(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows), "pii-train")
    fit = train.where("not rest")
    if fit.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    bins = max(32, math.isqrt(fit.count()) + 1)  # with fewer, Spark draws rows to find splits once they exceed the square
    gbt = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=3, checkpointInterval=-1, cacheNodeIds=False, maxBins=bins, weightCol="weight")
    model = gbt.fit(fit)
    raw = sum((F.lit(w) * _tree(t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)), F.lit(0.0))
    score = 1 / (1 + F.exp(-2 * raw))
    steps = train.where("rest").select("kind", "sure", "label", "n", F.floor(score * 20).alias("step")).groupBy("kind", "sure", "step").agg(
        F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("hits")
    ).collect()  # at most 20 steps of each kind, twice
    cuts = {}
    for kind in CUE_OF:
        n = hits = 0
        for r in sorted((r for r in steps if r["kind"] == kind and not r["sure"]), key=lambda r: -r["step"]):
            n, hits = n + r["n"], hits + r["hits"]
            if r["step"] >= 10 and hits >= precision * n:
                cuts[kind] = r["step"] / 20
    told = []
    for kind, name in enumerate(KINDS[4:], 4):
        of = lambda sure, least=0: [r for r in steps if (r["kind"], r["sure"]) == (kind, sure) and r["step"] >= least]  # noqa: E731, B023
        total = lambda rows, c="n": int(sum(r[c] for r in rows))
        at = 20 * cuts.get(kind, 0.5)
        told.append({
            "kind": name, "threshold": cuts.get(kind), "base": total(of(1.0)), "base_above": total(of(1.0, at)), "open": total(of(0.0)),
            "open_personal": total(of(0.0), "hits"), "open_above": total(of(0.0, at)), "hits_above": total(of(0.0, at), "hits"),
        })
    return score, cuts, told


def pii_calibration(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, precision: float = 0.95) -> list[dict]:
    """What was held out of the fit, by kind: its threshold (null where none is
    set; figures are then from 0.5 on), base matches and how many score above it,
    other candidates, how many have a cue, how many score above it and how many of
    those have a cue. Empty where nothing can be fitted."""
    fitted = _fitted(stage(_parts(docs, id_col, text_col), "candidates"), sample, precision)
    return fitted[2] if fitted else []


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              sample: int = 20_000, precision: float = 0.95) -> DataFrame:
    """(id, base, spans) per row of ``docs``: arrays of struct<start, kind, end>;
    kind counts KINDS. ``base`` has the checked emails, addresses, cards and
    phones, ``spans`` also the candidates that the trees select.

    Generators propose overlapping spans freely; those that overlap a base span
    are dropped, the others are scored by boosted trees on their format and
    surroundings, and stay from their kind's threshold on, unless they overlap one
    with a higher score. A cue word of their kind in front keeps them too: it is
    what the trees learn from, so they add candidates that look like those with a
    cue and lack it. Trees and thresholds rest on all candidates of whole texts,
    counted by their features; ``sample`` bounds how much a kind weighs. A kind has no threshold
    where too few were held out or none reaches ``precision``.

    Null text counts as empty and has no spans. Rows with null ids are scanned
    like others; repeated rows each get the same spans; other columns are
    ignored; no rows give no rows. Where they have a single class, no kind
    has a threshold. Candidates, not texts, are shuffled.
    """
    parts = stage(_parts(docs, id_col, text_col), "candidates")
    fitted = _fitted(parts, sample, precision)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    score, cuts, _ = fitted or (F.lit(0.0), {}, [])
    cued = lambda k, c: (F.col(f"cue_{c}") > 0) | (F.col("score") >= cuts.get(k, 2.0))
    passes = F.coalesce(*(F.when(F.col("kind") == k, cued(k, c)) for k, c in CUE_OF.items()))
    rows = _featured(parts.where(F.size("open") > 0).select(*KEY, F.explode("open").alias("c"))).withColumn("score", score)
    # a filter on the score would be pushed below it, trees and patterns twice
    kept = F.when(passes, F.array(F.struct("score", "c.start", "c.kind", "c.end")))
    picked = rows.select(*KEY, F.explode(kept).alias("x")).groupBy(*KEY).agg(F.collect_set("x").alias("p"))

    def best(x: Column) -> Column:
        worse = lambda o: (x["start"] < o["end"]) & (o["start"] < x["end"]) & (x < o)
        return ~F.exists("p", worse)

    chosen = F.transform(F.filter("p", best), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    found = parts.join(picked.select(*KEY, chosen.alias("added")), KEY, "left")
    return found.select("id", "base", F.concat("base", F.coalesce("added", none)).alias("spans"))
