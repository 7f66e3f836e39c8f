"""Product names, sizes and catalogue values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spelled-out forms of tokens.
ABBREVIATIONS = {
    "vnsn": "venison", "chkn": "chicken", "ckn": "chicken", "trky": "turkey", "slmn": "salmon", "brly": "barley", "vgg": "veggie", "vegggie": "veggie", "frzn": "frozen",
}
#: Grams in an ounce, ounces in a pound.
GRAMS, OUNCES = 28.349523125, 16.0
#: Unit names and their short forms.
UNITS = {
    "ounce": "oz", "ounces": "oz", "fluid ounce": "fl oz", "lbs": "lb", "pound": "lb", "pounds": "lb", "kilogram": "kg", "kilograms": "kg", "gram": "g", "grams": "g",
}
#: Sizes that are glued to a brand, and to a word's end.
SIZES = "SM|MD|LG|XL|XS|XXL"
ENDINGS = "XXL|MINI|JUMBO|SM|MD|LG|XL"
#: Legal forms behind a brand, and marks that brands are compared without.
LEGAL_FORMS = "inc|llc|ltd|limited|co|company|brands|group|corporation|corp"
MARKS = "®™©℠℗[]{}()'\""
#: Characters that part a name from what stands around it.
EDGES = ",-–—|: "


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), c), c)


def ounces(c: Column) -> Column:
    """A number with one unit of weight as ounces, to four digits; else null."""
    pattern = r"^([0-9.,]+)\s*(oz|ounces?|lb|lbs|pounds?|g|grams?|kg|kilograms?)\.?$"
    t = F.lower(F.trim(c))
    n, unit = F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit("")).try_cast("double"), F.regexp_extract(t, pattern, 2)
    value = F.when(unit.startswith("o"), n).when(unit.startswith("l") | unit.startswith("p"), n * OUNCES).when(unit.startswith("g"), n / GRAMS)
    return F.when(n > 0, F.round(value.when(unit.startswith("k"), n * 1000 / GRAMS), 4))


def net_content(c: Column) -> Column:
    """(value, unit) of a number and a unit that are the whole text; else null."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z\s]+?)\s*$"
    value, unit = F.regexp_extract(c, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(c, pattern, 2))
    return F.when((value > 0) & (unit != ""), F.struct(value.alias("value"), _named(unit, UNITS).alias("unit")))


def group_brand(c: Column) -> Column:
    """Lower case, without marks, brackets, quotes and a closing legal form."""
    bare = F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKS, "")
    return F.trim(F.regexp_replace(bare, rf"\b({LEGAL_FORMS})\b\.?$", ""))


def expand(c: Column) -> Column:
    """Lower-case words with their abbreviations spelled out."""
    for short, long in ABBREVIATIONS.items():
        c = F.regexp_replace(c, f"(?<![a-z]){short}(?![a-z])", long)
    return c


def split_sizes(c: Column) -> Column:
    """Blanks between a word and a size glued to its end, where both are capitals
    or the word has no vowel."""
    caps = F.regexp_replace(c, rf"(?<![A-Za-z])([A-Z]{{3,}})({ENDINGS})\b", "$1 $2")
    bare = F.regexp_replace(caps, rf"(?<![A-Za-z])([b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]{{3,}})({ENDINGS})\b", "$1 $2")
    return F.regexp_replace(bare, r"(?i)\b(SM|MD|LG|XL|XXL)(harvest)\b", "$1 $2")


def _tokens(c: Column) -> Column:
    """The runs of letters and digits of a text, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def _times(words: Column, part: Column) -> Column:
    """How often the words of ``part`` follow each other in ``words``."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    return F.when(F.size(part) > 0, F.size(F.filter(starts, lambda k: F.slice(words, k, F.size(part)) == part))).otherwise(0)


def split_before_brand(name: Column, brand: Column) -> Column:
    """A blank between a size that begins a word and the row's own brand glued to it."""
    words, own = F.split(name, " "), F.array_join(F.filter(F.split(F.lower(brand), " "), lambda w: w != ""), " ")

    def parted(word: Column, at: Column) -> Column:
        ahead = F.lower(F.array_join(F.slice(words, at + 1, F.size(words)), " "))
        cut = [F.when(ahead.startswith(F.concat(F.lit(size.lower()), own)), F.concat_ws(" ", F.left(word, F.lit(len(size))), F.substring(word, len(size) + 1, 1 << 20))) for size in SIZES.split("|")]
        return F.coalesce(*cut, word)

    return F.when(own != "", F.array_join(F.transform(words, parted), " ")).otherwise(name)


def brand_first(name: Column, brand: Column) -> Column:
    """A brand whose words stand once, and at the very end, moved to the front."""
    words, own = _tokens(name), _tokens(brand)
    last = F.concat(F.lit("([^A-Za-z0-9]*[A-Za-z0-9]+){"), F.greatest(F.size(own), F.lit(1)).cast("string"), F.lit("}$"))
    rest = F.btrim(F.regexp_replace(name, last, F.lit("")), F.lit(EDGES))
    ends = (F.size(words) > F.size(own)) & (F.slice(words, -F.least(F.size(own), F.size(words)), F.size(own)) == own) & name.rlike("[A-Za-z0-9]$")
    return F.when((_times(words, own) == 1) & ends & (rest != ""), F.concat(F.trim(brand), F.lit(" "), rest)).otherwise(name)


def clean(c: Column) -> Column:
    """Without separators at the ends and a closing run of eight digits or more."""
    t = F.regexp_replace(F.btrim(c, F.lit(EDGES)), r"\s+[0-9]{8,}$", "")
    return F.when(t != "", t).otherwise(F.trim(c))


def file_name(c: Column) -> Column:
    """Every ASCII character but letters, digits, dot, hyphen and underscore as % and its hex code."""
    one = lambda x: F.when(x.rlike("^[A-Za-z0-9._-]$"), x).otherwise(F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x).cast("long")), 2, "0")))
    return F.when(c.rlike("^[A-Za-z0-9._-]*$"), c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def value_key(c: Column) -> Column:
    """Under which controlled values are equal; null where nothing is left."""
    t = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(t != "", t)


def tag_type(c: Column) -> Column:
    number, yes = ("Price", "SaleAmount", "Weight", "QuantityOnHand"), ("Taxable", "ProductDisabled")
    return F.when(c.isin(*number), "number").when(c.contains("Image") | c.isin("Graphic", "MoreInformationGraphic"), "image").when(c.isin(*yes), "boolean").otherwise("string")


def wall_to_utc(wall: Column, zone: str) -> Column:
    """The first instant at which clocks of a zone show a time, or the first
    quarter of an hour after it where they skip it."""
    guess = F.to_utc_timestamp(wall, zone)
    each = F.sequence(guess - F.expr("INTERVAL 2 HOURS"), guess + F.expr("INTERVAL 2 HOURS"), F.expr("INTERVAL 15 MINUTES"))
    return F.array_min(F.filter(each, lambda x: F.from_utc_timestamp(x, zone) >= wall))


def life_stage(c: Column) -> Column:
    """The life stage that a title covers without doubt, else null."""
    t = F.lower(c)
    adult, puppy, kitten = t.rlike(r"\badult\b"), t.rlike(r"\b(puppy|puppies)\b"), t.rlike(r"\bkittens?\b")
    every = t.rlike(r"\bdogs\s*&\s*puppies\b") | (adult & puppy)
    return F.when(every, "All Life Stages").when(puppy & ~kitten, "Puppy")


def brand_count(title: Column, brand: Column) -> Column:
    """How often the words of a brand stand in a title as words of their own."""
    return _times(_tokens(title), _tokens(brand))
