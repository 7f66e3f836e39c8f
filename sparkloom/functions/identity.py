"""Product identifiers, measures and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pounds in a unit.
POUNDS = {"lb": 1.0, "oz": 0.0625, "kg": 2.2046226218, "g": 0.0022046226218}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def gtin(c: Column) -> Column:
    """Digits of an 8, 12, 13 or 14 digit code, else null."""
    d = digits(c)
    return F.when(F.length(d).isin(8, 12, 13, 14), d)


def gtin_valid(code: Column) -> Column:
    """Check digit by weights 3 and 1 from the right, over all but the last digit."""
    body = F.reverse(F.lpad(code, 14, "0"))
    total = sum((F.substring(body, k + 1, 1).cast("int") * (3 if k % 2 else 1) for k in range(1, 14)), F.lit(0))
    return (F.lit(10) - total % 10) % 10 == F.substring(body, 1, 1).cast("int")


def gtin14(code: Column) -> Column:
    return F.lpad(code, 14, "0")


def pounds(c: Column) -> Column:
    """A number with one unit as pounds to two digits; without a unit it is
    pounds; null for anything else."""
    t = F.lower(F.trim(c))
    pattern = r"^([0-9]+(?:\.[0-9]+)?) ?(lbs?|oz|kg|g)?$"
    number = F.regexp_extract(t, pattern, 1).try_cast("double")
    unit = F.regexp_replace(F.regexp_extract(t, pattern, 2), "^lbs$", "lb")
    factor = F.when(unit == "", 1.0)
    for name, value in POUNDS.items():
        factor = factor.when(unit == name, value)
    return F.when(t.rlike(pattern), F.round(number * factor, 2))


def pounds_lenient(c: Column) -> Column:
    """The first number with a unit anywhere in the text as pounds to two digits,
    or the first number of all as pounds; null without a number."""
    t, pattern = F.lower(c), r"([0-9]+(?:\.[0-9]+)?)\s*(lbs?|kg|grams?|g|oz|ounces?|pounds?)\b"
    number, unit = F.regexp_extract(t, pattern, 1), F.substring(F.regexp_extract(t, pattern, 2), 1, 1)
    factor = F.when(unit.isin("l", "p"), 1.0).when(unit == "k", POUNDS["kg"]).when(unit == "g", POUNDS["g"]).otherwise(POUNDS["oz"])
    bare = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(number != "", F.round(number.try_cast("double") * factor, 2)).when(bare != "", F.round(bare.try_cast("double"), 2))


def text_key(c: Column) -> Column:
    """Trimmed, with single blanks; null where nothing is left."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t != "", t)


def price_key(c: Column) -> Column:
    """A number without separators and trailing zeros as text; other text
    trimmed; null where nothing is left."""
    t = F.trim(c)
    plain = F.replace(t, F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.round(plain.try_cast("double"), 6).cast("string")).when(t != "", t)


def pack_count(c: Column) -> Column:
    """Unsigned whole number without leading zeros, else null."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", ""))


def brand_key(c: Column) -> Column:
    """Trimmed, single blanks, lower case; null where nothing is left."""
    t = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(t != "", t)


def for_comparison(field: Column, raw: Column) -> Column:
    """struct<value, status> by the rule of the field: weights in pounds, brands
    and pack counts by key; ``failed`` keeps what has no such form, other fields
    are ``unchanged``."""
    keyed = F.when(field == "weight", F.format_string("%.2f", pounds(raw))).when(field == "brand", brand_key(raw)).when(field == "packCount", pack_count(raw))
    known = F.coalesce(field.isin("weight", "brand", "packCount"), F.lit(False))
    keyed = F.when((field == "weight") & pounds(raw).isNull(), None).otherwise(keyed)
    status = F.when(~known, "unchanged").when(keyed.isNull(), "failed").otherwise("normalized")
    return F.struct(F.coalesce(keyed, raw).alias("value"), status.alias("status"))


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def name_stem(c: Column) -> Column:
    """Lower case without sizes and trailing counts."""
    t = F.regexp_replace(F.lower(c), r"\b[0-9]+(\.[0-9]+)? ?(oz|lbs?|kg|g|ml|l)\b", " ")
    t = F.regexp_replace(t, r"[ ,-]*\b(pack of )?[0-9]+( ?(ct|pk|count))?$", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a hash of the UTF-8 bytes of an ASCII string."""
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.split(c, ""), F.lit(2166136261).cast("long"), step)
