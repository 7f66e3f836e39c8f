"""Parts and identities of URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that name a visit and not a page, and the prefix of others.
TRACKING, TRACKING_PREFIX = ("gclid", "fbclid", "msclkid", "gbraid", "wbraid", "dclid"), "utm_"
#: Parameters that choose a variant of a page, and the prefixes of others.
VARIANT, VARIANT_PREFIXES = ("variant", "variation_id", "sku"), ("attribute_", "option")
#: Common second levels under which names are registered.
SECOND_LEVEL = ("co", "com", "org", "net", "ac")


def host(u: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]+)", 1)), ":(80|443)$", "")


def path(u: Column) -> Column:
    p = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    return F.regexp_replace(p, "/+$", "")


def _name(part: Column) -> Column:
    return F.regexp_extract(part, "^([^=]*)", 1)


def tracking(part: Column) -> Column:
    name = F.lower(_name(part))
    return name.isin(*TRACKING) | name.startswith(TRACKING_PREFIX)


def variant(part: Column) -> Column:
    name = F.lower(_name(part))
    found = name.isin(*VARIANT)
    for p in VARIANT_PREFIXES:
        found = found | name.startswith(p)
    return found


def query(u: Column, drop) -> Column:
    """The parameters for which ``drop`` does not hold, by name and then value."""
    parts = F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&")
    kept = F.filter(parts, lambda x: (x != "") & ~drop(x))
    pairs = F.array_sort(F.transform(kept, lambda x: F.struct(_name(x).alias("k"), x.alias("x"))))
    return F.array_join(F.transform(pairs, lambda p: p["x"]), "&")


def identity_key(u: Column, drop=tracking) -> Column:
    """The address of a page: scheme and host in lower case without a default
    port, the path as it stands, sorted parameters without those of tracking, and
    a fragment. Anything but http and https stays as it is."""
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z]+)://", 1))
    at = F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]+)", 1))
    at = F.when(scheme == "http", F.regexp_replace(at, ":80$", "")).otherwise(F.regexp_replace(at, ":443$", ""))
    place = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    q, fragment = query(u, drop), F.regexp_extract(u, "#(.*)$", 1)
    some = lambda sign, x: F.when(x != "", F.concat(F.lit(sign), x)).otherwise("")
    whole = F.concat(scheme, F.lit("://"), at, F.when(place == "", "/").otherwise(place), some("?", q), some("#", fragment))
    return F.when(scheme.isin("http", "https"), whole).otherwise(u)


def parent_key(u: Column) -> Column:
    """``identity_key`` without the parameters that choose a variant."""
    return identity_key(u, lambda x: tracking(x) | variant(x))


def deep_link(parent: Column, link: Column, platform: Column) -> Column:
    """The key of a variant's page: the parent's address with the variant
    parameters of ``link`` instead of its own. Without a link, ``platform`` is the
    variant's number; without either the parent stays as it is. A fragment of the
    link goes before the parent's."""
    link = F.coalesce(link, F.concat(F.lit("?variant="), platform.cast("string")))
    split = lambda u: F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    parts = F.concat(F.filter(split(parent), lambda x: ~variant(x)), F.filter(split(link), variant))
    own, other = F.regexp_extract(parent, "#(.*)$", 1), F.regexp_extract(link, "#(.*)$", 1)
    tail = F.when(other != "", other).otherwise(own)
    some = lambda sign, x: F.when(x != "", F.concat(F.lit(sign), x)).otherwise("")
    whole = F.concat(F.regexp_extract(parent, "^([^?#]*)", 1), some("?", F.array_join(parts, "&")), some("#", tail))
    return F.when(link.isNotNull(), identity_key(whole)).otherwise(parent)


def registrable_domain(h: Column) -> Column:
    """The registered name and its suffix."""
    labels = F.split(h, r"\.")
    second = F.get(labels, F.size(labels) - 2)
    n = F.when((F.size(labels) > 2) & second.isin(*SECOND_LEVEL), 3).otherwise(2)
    return F.array_join(F.slice(labels, -F.least(n, F.size(labels)), F.least(n, F.size(labels))), ".")


def slug(u: Column) -> Column:
    """The last segment of the path without its extension."""
    return F.regexp_replace(F.regexp_extract(path(u), "([^/]*)$", 1), r"\.[a-z]{2,5}$", "")


def prefix(u: Column) -> Column:
    return F.regexp_extract(path(u), "^/([^/]+)", 1)
