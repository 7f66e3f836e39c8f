"""File sources and sinks: delimited text, JSON lines, XML, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of header names, by the field that they name.
HEADERS = {
    "upc": r"\b(upc|ean|gtin|barcode)\b", "sku": r"\b(sku|item ?(no|number|#))\b", "name": r"\b(name|title|product)\b",
    "brand": r"\bbrand|manufacturer\b", "price": r"\b(price|msrp|cost)\b", "weight": r"\bweight\b", "description": r"\bdesc(ription)?\b",
}


def delimited(spark: SparkSession, path: str, **options) -> DataFrame:
    """Delimited text with a header; every cell a string, empty where missing."""
    df = spark.read.option("header", True).option("multiLine", True).options(**options).csv(path)
    return df.na.fill("")


def column_mapping(headers: list[str]) -> dict[str, str]:
    """field -> first header that its pattern fits; a header serves one field."""
    import re

    found: dict[str, str] = {}
    for field, pattern in HEADERS.items():
        for h in headers:
            if h not in found.values() and re.search(pattern, h, re.I):
                found[field] = h
                break
    return found


def map_rows(df: DataFrame, mapping: dict[str, str], required: tuple[str, ...] = ("upc", "name")) -> DataFrame:
    """The mapped fields and ``errors``, the required fields that are empty; rows
    without errors are valid."""
    cols = [F.trim(F.col(f"`{h}`")).alias(f) for f, h in mapping.items()]
    missing = [F.when(F.col(f) == "", F.lit(f"missing_{f}")) if f in mapping else F.lit(f"missing_{f}") for f in required]
    return df.select(*cols).withColumn("errors", F.array_compact(F.array(*missing)))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines as ``record`` by schema, with ``line`` and ``outcome``: accepted or
    invalid_json; blank lines are dropped."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"))
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select("line", parsed.alias("record")).select(
        "line", F.when(F.col("record._bad").isNotNull() | F.col("record").isNull(), "invalid_json").otherwise("accepted").alias("outcome"), "record"
    )


def write_sorted_json_lines(df: DataFrame, path: str, key: str) -> None:
    """One JSON object a line with its keys in order, range-sorted by ``key``."""
    ordered = df.select(*sorted(df.columns))
    ordered.repartitionByRange(key).sortWithinPartitions(key).select(F.to_json(F.struct(*ordered.columns)).alias("value")).write.text(path)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def sanitize_xml(c: Column) -> Column:
    """Without control characters, and with bare ampersands as entities."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.regexp_replace(c, r"&(?!#[0-9]+;|#x[0-9a-fA-F]+;|[a-zA-Z]+;)", "&amp;")


def decode_numeric_entities(c: Column) -> Column:
    """Decimal character references as their characters."""
    parts = F.split(c, r"&#(?=[0-9]+;)")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: F.concat(
        F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(p, "^([0-9]+);", 1).cast("long")), 8, "0")), "UTF-32"), F.regexp_replace(p, "^[0-9]+;", "")
    ))
    return F.concat(F.get(parts, 0), F.array_join(rest, ""))


def escape_cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def encode_xml(df: DataFrame, row_tag: str, key: str) -> DataFrame:
    """(key, xml): each row as an element with one CDATA child for each column."""
    child = lambda n: F.concat(F.lit(f"<{n}>"), escape_cdata(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit(f"</{n}>"))
    return df.select(key, F.concat(F.lit(f"<{row_tag}>"), *(child(n) for n in df.columns), F.lit(f"</{row_tag}>")).alias("xml"))


def sitemap_urls(pages: DataFrame, column: str) -> DataFrame:
    """(loc, lastmod) of all entries of sitemap documents; of repeated locations
    the latest date stays."""
    entry = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)))
    rows = pages.select(entry.alias("e")).select(
        F.trim(F.regexp_extract("e", r"<loc>([^<]*)</loc>", 1)).alias("loc"), F.nullif(F.regexp_extract("e", r"<lastmod>([^<]*)</lastmod>", 1), F.lit("")).alias("lastmod")
    )
    return rows.where("loc <> ''").groupBy("loc").agg(F.max("lastmod").alias("lastmod"))
