"""Secret scans: multipart credential linking, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, text_or_empty
from .spans import free, keyed, matches, merged, redact

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: each alone is too common to report.
WEAK_ID = r"""(?<![A-Za-z0-9_])(?i:user(?:_?name)?|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
WEAK_ENDPOINT = r"""(?:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}"""
#: Roles of the kinds: identifier, secret, endpoint.
ROLES = {"assign": 1, "access": 0, "hex": 1, "id": 0, "secret": 1, "endpoint": 2}
#: Of spans that overlap, one of a higher rank is no part: a link's path is no secret, and an identifier's value not its own.
RANKS = {"assign": 0, "access": 0, "hex": 0, "endpoint": 1, "id": 2, "secret": 3}
#: Two parts are near if fewer code points than this lie between them.
SCOPE = 256
#: Rows with spans up to which their table is broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000
KEY = ["k1", "k2"]


def _row_key(id_col, text):
    """Two hashes that rows share only if id and text are the same; equal rows
    have equal results."""
    return [F.xxhash64(id_col, text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col("t")
    mixed = lambda x: x["s"].rlike("[0-9]") & x["s"].rlike("[a-z]") & x["s"].rlike("[A-Z]")
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs, text_col).alias("t"))
    rows = rows.select(
        "id", *_row_key("id", text),
        F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 1)) >= 6).alias("assign"),
        matches(text, ACCESS).alias("access"), matches(text, HEX).alias("hex"), matches(text, WEAK_ID).alias("wid"),
        F.filter(matches(text, WEAK_SECRET), mixed).alias("wsecret"), matches(text, WEAK_ENDPOINT).alias("wend"),
    )
    base = F.array_sort(F.concat(keyed(0, F.col("assign")), keyed(1, F.col("access")), keyed(2, F.col("hex"))))
    weak = F.concat(*(keyed(k, F.col(c)) for k, c in ((3, "wid"), (4, "wsecret"), (5, "wend"))))
    return rows.select("id", *KEY, base.alias("base"), weak.alias("weak"))


def linked_spans(parts: DataFrame) -> DataFrame:
    """(k1, k2, linked): the weak parts of each row that are near what complements
    them. An identifier needs a secret near it, a secret an identifier or
    endpoint, an endpoint both of the others. Weak spans that overlap a base span
    are no parts, nor are identifiers that overlap an endpoint and secrets that
    overlap either, so no part complements itself.

    Parts meet in buckets of SCOPE code points: each is sent to those it touches.
    A part that is near another touches the bucket of it or one beside, so for
    each role a bucket keeps the least start of its own parts and the next
    bucket's, and the greatest end of its own and the last bucket's; true
    distances to these two decide. So the result does not depend on where the
    text begins, and work grows with the parts and not with their pairs.
    """
    role = F.get(F.array(*(F.lit(ROLES[k]) for k in KINDS)), F.col("p.kind"))
    bucket = lambda at: F.floor(at / SCOPE)
    rows = parts.where(F.size("weak") > 0).select(*KEY, "base", "weak").dropDuplicates(KEY)
    rank = F.get(F.array(*(F.lit(RANKS[k]) for k in KINDS)), F.col("p.kind"))
    weak = free(rows.select(*KEY, F.explode(F.concat("base", "weak")).alias("p")), KEY, rank, 4)
    inside = weak.union(rows.select(*KEY, F.explode("base").alias("p")))
    inside = inside.select(*KEY, "p", role.alias("role"), F.explode(F.sequence(bucket(F.col("p.start")), bucket(F.col("p.end") - 1))).alias("scope"))
    of = lambda r, x: F.when(F.col("role") == r, F.col(x))
    ends = inside.groupBy(*KEY, "scope").agg(
        *(F.min(of(r, "p.start")).alias(f"low{r}") for r in range(3)), *(F.max(of(r, "p.end")).alias(f"high{r}") for r in range(3))
    )
    sent = ends.select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("by"))
    around = sent.groupBy(*KEY, (F.col("scope") + F.col("by")).alias("scope")).agg(
        *(F.min(F.when(F.col("by") <= 0, F.col(f"low{r}"))).alias(f"low{r}") for r in range(3)),
        *(F.max(F.when(F.col("by") >= 0, F.col(f"high{r}"))).alias(f"high{r}") for r in range(3)),
    )
    hits = inside.where(F.col("p.kind") > 2).join(around, [*KEY, "scope"])

    def near(r: int):
        after, before = F.col(f"low{r}") - F.col("p.end") < SCOPE, F.col("p.start") - F.col(f"high{r}") < SCOPE
        return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

    # a part may be near its complements from different buckets
    found = hits.groupBy(*KEY, "p", "role").agg(*(F.bool_or(near(r)).alias(f"near{r}") for r in range(3)))
    met = (
        F.when(F.col("role") == 0, F.col("near1")).when(F.col("role") == 1, F.col("near0") | F.col("near2"))
        .otherwise(F.col("near0") & F.col("near1"))
    )
    return found.where(met).groupBy(*KEY).agg(F.collect_set("p").alias("linked"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) per row of ``docs``: arrays of struct<start, kind, end>
    sorted by start and kind; kind counts KINDS. ``base`` has the assignments,
    access keys and hex strings, ``spans`` also the linked weak parts.

    Null text counts as empty and has no spans. Rows with null ids are scanned
    like others; repeated rows each get the same spans; other columns are
    ignored; no rows give no rows. Only parts, not texts, are shuffled.
    """
    parts = stage(_parts(docs, id_col, text_col), "parts")
    found = parts.join(linked_spans(parts), KEY, "left")
    linked = F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return found.select("id", "base", F.array_sort(F.concat("base", linked)).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by its kind in brackets.

    All rows stay, and null texts stay null; empty texts stay empty; rows with
    null ids are scanned like others; repeated rows are changed alike; no rows
    give no rows. Other columns are returned unchanged, whatever their names."""
    text = text_or_empty(docs, text_col)
    with scratch(docs.sparkSession) as put:
        parts = put(_parts(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("weak") > 0)), "parts")
        linked = linked_spans(parts).select(*KEY, F.explode("linked").alias("p"))
        base = parts.select(*KEY, "base").dropDuplicates(KEY).select(*KEY, F.explode("base").alias("p"))
        spans = stage(merged(base.union(linked), KEY), "secrets")
    found = docs.select(F.struct(*docs.columns).alias("row"), *(k.alias(n) for k, n in zip(_row_key(docs[id_col], text), KEY, strict=True)))
    few = spans.count() <= BROADCAST_ROWS
    found = found.join(F.broadcast(spans) if few else spans, KEY, "left")
    old = F.col("row")[text_col]
    new = F.when(F.col("spans").isNull(), old).otherwise(redact(old, F.col("spans"), KINDS))
    return found.select(*((new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
