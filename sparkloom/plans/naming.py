"""Names, sizes, hosts and codes in the forms in which they are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, naming
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


def _pick(key, *values):
    """The value of ``key`` modulo their number."""
    case = None
    for i, v in enumerate(values):
        hit = F.col(key) % len(values) == i
        case = F.when(hit, v) if case is None else case.when(hit, v)
    return case


def _parts(spark, sf_dir):
    return load(spark, sf_dir, "part"), F.col("p_size").cast("string")


@R.query(r"""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || ' oz' WHEN 1 THEN '1,' || lpad(p_size::VARCHAR, 3, '0') || ' Lbs.' WHEN 2 THEN p_size || 'g' WHEN 3 THEN p_size || '.5 kilograms' WHEN 4 THEN 'about ' || p_size ELSE '0 oz' END AS raw FROM part),
         m AS (SELECT *, regexp_extract(lower(raw), '^([0-9.,]+)\s*(oz|ounces?|lb|lbs|pounds?|g|grams?|kg|kilograms?)\.?$', 1) AS n, regexp_extract(lower(raw), '^([0-9.,]+)\s*(oz|ounces?|lb|lbs|pounds?|g|grams?|kg|kilograms?)\.?$', 2) AS u FROM r),
         v AS (SELECT *, TRY_CAST(replace(n, ',', '') AS DOUBLE) AS x FROM m)
    SELECT p_partkey, CASE WHEN x > 0 THEN round(CASE substr(u, 1, 1) WHEN 'o' THEN x WHEN 'l' THEN x * 16 WHEN 'g' THEN x / 28.349523125 WHEN 'k' THEN x * 1000 / 28.349523125 END, 4) END AS ounces FROM v""")
def q_ounces(spark, sf_dir):
    p, size = _parts(spark, sf_dir)
    raw = _pick(
        "p_partkey", F.concat(size, F.lit(" oz")), F.concat(F.lit("1,"), F.lpad(size, 3, "0"), F.lit(" Lbs.")), F.concat(size, F.lit("g")),
        F.concat(size, F.lit(".5 kilograms")), F.concat(F.lit("about "), size), F.lit("0 oz"),
    )
    return p.select("p_partkey", naming.ounces(raw).alias("ounces"))


@R.query(r"""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || ' Ounces ' WHEN 1 THEN p_size || '.5lb' WHEN 2 THEN 'size ' || p_size WHEN 3 THEN p_size || ' bags' ELSE '0 g' END AS raw FROM part),
         m AS (SELECT *, TRY_CAST(regexp_extract(raw, '^\s*([0-9]+(\.[0-9]+)?)\s*([a-zA-Z\s]+?)\s*$', 1) AS DOUBLE) AS v, lower(regexp_extract(raw, '^\s*([0-9]+(\.[0-9]+)?)\s*([a-zA-Z\s]+?)\s*$', 3)) AS u FROM r)
    SELECT p_partkey, CASE WHEN v > 0 THEN v END AS amount, CASE WHEN v > 0 THEN CASE WHEN u IN ('ounce', 'ounces') THEN 'oz' WHEN u IN ('lbs', 'pound', 'pounds') THEN 'lb' ELSE u END END AS unit FROM m""")
def q_net_content(spark, sf_dir):
    p, size = _parts(spark, sf_dir)
    raw = _pick("p_partkey", F.concat(F.lit(" "), size, F.lit(" Ounces ")), F.concat(size, F.lit(".5lb")), F.concat(F.lit("size "), size), F.concat(size, F.lit(" bags")), F.lit("0 g"))
    n = p.select("p_partkey", naming.net_content(raw).alias("n"))
    return n.select("p_partkey", F.col("n.value").alias("amount"), F.col("n.unit").alias("unit"))


@R.query(r"""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand || '™ Inc.' WHEN 1 THEN '"' || p_type || '" Brands' WHEN 2 THEN p_type || ' Co' WHEN 3 THEN 'Cobalt ' || p_type END AS raw FROM part)
    SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(coalesce(raw, '')), '[®™©℠℗\[\]{}()''"]', '', 'g'), '\b(inc|llc|ltd|limited|co|company|brands|group|corporation|corp)\b\.?$', '')) AS brand FROM r""")
def q_group_brand(spark, sf_dir):
    p, _ = _parts(spark, sf_dir)
    raw = _pick("p_partkey", F.concat("p_brand", F.lit("™ Inc.")), F.concat(F.lit('"'), "p_type", F.lit('" Brands')), F.concat("p_type", F.lit(" Co")), F.concat(F.lit("Cobalt "), "p_type"), F.lit(None))
    return p.select("p_partkey", naming.group_brand(raw).alias("brand"))


@R.query(r"""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'vnsn chkn ' || p_name WHEN 1 THEN 'ckn-frzn ' || p_name WHEN 2 THEN upper(p_type) || 'LG' WHEN 3 THEN 'trkyXL ' || p_name WHEN 4 THEN 'ClassicLg ' || p_name ELSE 'LGHARVEST SMOOTH' END AS raw FROM part),
         e AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'venison chicken ' || substr(raw, 11) WHEN 1 THEN 'chicken-frozen ' || substr(raw, 10) WHEN 3 THEN 'turkeyXL' || substr(raw, 7) ELSE raw END AS expanded, raw FROM r)
    SELECT p_partkey, expanded, CASE p_partkey % 6 WHEN 2 THEN left(raw, length(raw) - 2) || ' LG' WHEN 3 THEN 'trky XL' || substr(raw, 7) WHEN 5 THEN 'LG HARVEST SMOOTH' ELSE raw END AS parted FROM e""")
def q_name_tokens(spark, sf_dir):
    p, _ = _parts(spark, sf_dir)
    raw = _pick(
        "p_partkey", F.concat(F.lit("vnsn chkn "), "p_name"), F.concat(F.lit("ckn-frzn "), "p_name"), F.concat(F.upper("p_type"), F.lit("LG")), F.concat(F.lit("trkyXL "), "p_name"),
        F.concat(F.lit("ClassicLg "), "p_name"), F.lit("LGHARVEST SMOOTH"),
    )
    return p.select("p_partkey", naming.expand(raw).alias("expanded"), naming.split_sizes(raw).alias("parted"))


@R.query(r"""
    WITH r AS (SELECT p_partkey, p_type || ' Lane' AS brand, CASE p_partkey % 5 WHEN 0 THEN p_name || ' LG' || upper(p_type) || ' LANE' WHEN 1 THEN p_name || ', ' || lower(p_type) || '-lane' WHEN 2 THEN p_type || ' Lane ' || p_name
                        WHEN 3 THEN p_name || ' ' || p_type || ' Lane ' || p_type || ' Lane' ELSE p_name END AS name, p_name, p_type FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' LG ' || upper(p_type) || ' LANE' ELSE name END AS parted,
           CASE p_partkey % 5 WHEN 1 THEN brand || ' ' || p_name ELSE name END AS fronted FROM r""")
def q_brand_front(spark, sf_dir):
    p, _ = _parts(spark, sf_dir)
    brand, b = F.concat("p_type", F.lit(" Lane")), F.lit(" ")
    name = _pick(
        "p_partkey", F.concat("p_name", F.lit(" LG"), F.upper("p_type"), F.lit(" LANE")), F.concat("p_name", F.lit(", "), F.lower("p_type"), F.lit("-lane")), F.concat(brand, b, "p_name"),
        F.concat("p_name", b, brand, b, brand), F.col("p_name"),
    )
    r = p.select("p_partkey", name.alias("name"), brand.alias("brand"))
    return r.select("p_partkey", naming.split_before_brand(F.col("name"), F.col("brand")).alias("parted"), naming.brand_first(F.col("name"), F.col("brand")).alias("fronted"))


@R.query(r"""
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '|' ELSE p_name END AS name,
           CASE p_partkey % 3 WHEN 0 THEN 'A%20' || p_size WHEN 1 THEN 'a.b-' || p_size || '_c' ELSE 'x%2F' || p_size || '%25' END AS file FROM part""")
def q_clean_name(spark, sf_dir):
    """Names without what extraction leaves at their ends, and codes as file names."""
    p, size = _parts(spark, sf_dir)
    raw = _pick("p_partkey", F.concat(F.lit("- "), "p_name", F.lit(" |")), F.concat("p_name", F.lit(" 012345678905")), F.concat("p_name", F.lit(":,")), F.lit("|"))
    code = _pick("p_partkey", F.concat(F.lit("A "), size), F.concat(F.lit("a.b-"), size, F.lit("_c")), F.concat(F.lit("x/"), size, F.lit("%")))
    return p.select("p_partkey", naming.clean(raw).alias("name"), naming.file_name(code).alias("file"))


@R.query(r"""
    WITH allowed AS (SELECT DISTINCT p_brand || ' ' || p_type AS v FROM part UNION SELECT DISTINCT upper(p_brand || ' ' || p_type) FROM part WHERE p_type = 'SMALL'),
         k AS (SELECT lower(trim(v)) AS k, count(*) AS n, min(v) AS v FROM allowed GROUP BY 1),
         c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' ' || lower(p_brand) || '  ' || p_type WHEN 1 THEN p_brand ELSE ' ' END AS raw FROM part)
    SELECT p_partkey, CASE WHEN k.n = 1 THEN k.v END AS resolved FROM c LEFT JOIN k ON k.k = lower(trim(regexp_replace(c.raw, '\s+', ' ', 'g')))""")
def q_canonical_match(spark, sf_dir):
    """The one allowed value that a raw value stands for; null where none or more do."""
    p, _ = _parts(spark, sf_dir)
    v = F.concat_ws(" ", "p_brand", "p_type")
    allowed = p.select(v.alias("v")).union(p.where("p_type = 'SMALL'").select(F.upper(v))).distinct()
    keys = allowed.groupBy(naming.value_key(F.col("v")).alias("k")).agg(F.when(F.count("*") == 1, F.min("v")).alias("resolved"))
    raw = _pick("p_partkey", F.concat(F.lit(" "), F.lower("p_brand"), F.lit("  "), "p_type"), F.col("p_brand"), F.lit(" "))
    return p.select("p_partkey", naming.value_key(raw).alias("k")).join(keys, "k", "left").select("p_partkey", "resolved")


@R.query(r"""
    WITH t AS (SELECT p_partkey, ['Price', 'Graphic', 'Taxable', 'Name', 'MoreImage3', 'Weight', 'ProductDisabled', 'Image' || p_size][(p_partkey % 8 + 1)::INTEGER] AS tag FROM part)
    SELECT CASE WHEN tag IN ('Price', 'Weight') THEN 'number' WHEN tag LIKE '%Image%' OR tag = 'Graphic' THEN 'image' WHEN tag IN ('Taxable', 'ProductDisabled') THEN 'boolean' ELSE 'string' END AS kind,
           count(*) AS n, count(DISTINCT tag) AS tags FROM t GROUP BY 1""")
def q_tag_types(spark, sf_dir):
    p, size = _parts(spark, sf_dir)
    tag = _pick("p_partkey", *(F.lit(x) for x in ("Price", "Graphic", "Taxable", "Name", "MoreImage3", "Weight", "ProductDisabled")), F.concat(F.lit("Image"), size))
    return p.select(tag.alias("tag")).groupBy(naming.tag_type(F.col("tag")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("tag").alias("tags"))


@R.query("""
    WITH d AS (SELECT DISTINCT date_trunc('day', o_orderdate) + to_minutes((2 * 60 + o_custkey % 4 * 15)::INTEGER) AS wall FROM orders),
         u AS (SELECT wall, timezone('UTC', timezone('America/New_York', wall)) AS utc FROM d)
    SELECT wall, CASE WHEN timezone('America/New_York', timezone('UTC', utc)) = wall THEN utc ELSE date_trunc('hour', utc) END AS utc FROM u""")
def q_zoned_run(spark, sf_dir):
    """Wall-clock times of New York as instants; one that the clocks skip is the next that exists."""
    o = load(spark, sf_dir, "orders")
    minutes = F.lit(120) + F.col("o_custkey") % 4 * 15
    wall = F.date_trunc("day", "o_orderdate") + F.make_dt_interval(mins=minutes.cast("int"))
    return o.select(wall.alias("wall")).distinct().select("wall", naming.wall_to_utc(F.col("wall"), "America/New_York").alias("utc"))


@R.query(r"""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Adult Dogs & Puppies ' || p_size WHEN 1 THEN 'adult puppy mix' WHEN 2 THEN 'Puppies only' WHEN 3 THEN 'puppy and kitten' ELSE 'junior growth' END AS t, p_brand || ' bag, ' || p_brand || '-' || p_size || ' oz ' || p_brand || '0' AS title, p_brand AS b FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'All Life Stages' WHEN 1 THEN 'All Life Stages' WHEN 2 THEN 'Puppy' END AS stage, 2::BIGINT AS brands, true AS measured FROM r""")
def q_title_checks(spark, sf_dir):
    """Life stage of a title, how often its brand stands in it, and whether it names a measure."""
    p, size = _parts(spark, sf_dir)
    t = _pick("p_partkey", F.concat(F.lit("Adult Dogs & Puppies "), size), F.lit("adult puppy mix"), F.lit("Puppies only"), F.lit("puppy and kitten"), F.lit("junior growth"))
    title = F.concat("p_brand", F.lit(" bag, "), "p_brand", F.lit("-"), size, F.lit(" oz "), "p_brand", F.lit("0"))
    r = p.select("p_partkey", naming.life_stage(t).alias("stage"), title.alias("title"), "p_brand")
    return r.select("p_partkey", "stage", naming.brand_count(F.col("title"), F.col("p_brand")).cast("long").alias("brands"), F.col("title").rlike(r"(?i)\b[0-9]+(\.[0-9]+)? ?(oz|lbs?|kg|g|ml|l)\b").alias("measured"))


@R.query("""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 16.0 WHEN 1 THEN p_size::DOUBLE END AS oz, CASE WHEN p_partkey % 4 <> 3 THEN lower(p_type) END AS unit FROM part),
         k AS (SELECT p_partkey, 'food|' || round(oz)::BIGINT || '|' || coalesce(unit, '') AS tuple FROM r)
    SELECT p_partkey, tuple, tuple IS NOT NULL AND count(*) OVER (PARTITION BY tuple) > 1 AS repeated FROM k""")
def q_variant_tuple(spark, sf_dir):
    """Weight and unit as one key; unknown weights equal nothing. Counted by key, as keys may be hot."""
    p, size = _parts(spark, sf_dir)
    oz = F.round(naming.ounces(_pick("p_partkey", F.concat(size, F.lit(" lb")), F.concat(size, F.lit(" oz")), F.lit("?")))).cast("long")
    unit = naming.value_key(F.when(F.col("p_partkey") % 4 != 3, F.concat(F.lit(" "), "p_type")))
    k = p.select("p_partkey", F.concat(F.lit("food|"), oz, F.lit("|"), F.coalesce(unit, F.lit(""))).alias("tuple"))
    many = k.where("tuple IS NOT NULL").groupBy("tuple").agg((F.count("*") > 1).alias("repeated"))
    return k.join(many, "tuple", "left").select("p_partkey", "tuple", F.coalesce("repeated", F.lit(False)).alias("repeated"))


_HOST = r"regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1)"


@R.query(rf"""
    WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages), d AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS domain FROM h WHERE page_id % 3 = 0)
    SELECT page_id, regexp_replace(host, '^www\.', '') AS hub, EXISTS (SELECT 1 FROM d WHERE h.host = d.domain OR h.host LIKE '%.' || d.domain) AS approved,
           regexp_matches(url, '/[a-z]{{2}}/[0-9]+') AS product, CASE WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%#%' THEN 'fragment' ELSE 'plain' END AS shape FROM h""")
def q_approved_hosts(spark, sf_dir):
    """Pages whose host is an approved domain or lies under one. A host posts its
    suffixes, so the join is by equality and a page meets at most its labels."""
    u = F.col("url")
    host = F.regexp_extract(F.lower(u), "^[a-z]+://([^/?#:]*)", 1)
    h = load(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"))
    domains = h.where("page_id % 3 = 0").select(F.regexp_replace("host", r"^(www|m|blog)\.", "").alias("suffix")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = h.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(domains, "suffix", "left_semi").select("host").distinct().withColumn("hit", F.lit(True))
    shape = F.when(u.contains("?"), "query").when(u.contains("#"), "fragment").otherwise("plain")
    return h.join(hosts, "host", "left").select(
        "page_id", F.regexp_replace("host", r"^www\.", "").alias("hub"), F.col("hit").isNotNull().alias("approved"), u.rlike("/[a-z]{2}/[0-9]+").alias("product"), shape.alias("shape")
    )


@R.query(r"""
    WITH h AS (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN '<meta itemprop="gtin13" content="' || lpad(page_id::VARCHAR, 13, '0') || '">' WHEN 1 THEN '{"gtin12": "' || lpad(page_id::VARCHAR, 12, '0') || '", "gtin": "77"}' ELSE '' END AS html FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'microdata' ELSE 'json' END AS source, lpad(page_id::VARCHAR, 14, '0') AS code FROM h WHERE page_id % 4 < 2""")
def q_page_codes(spark, sf_dir):
    """Product codes that a page states in attributes or JSON, padded to 14 digits."""
    no = F.col("page_id").cast("string")
    meta, doc = F.concat(F.lit('<meta itemprop="gtin13" content="'), F.lpad(no, 13, "0"), F.lit('">')), F.concat(F.lit('{"gtin12": "'), F.lpad(no, 12, "0"), F.lit('", "gtin": "77"}'))
    html = F.concat("html", _pick("page_id", meta, doc, F.lit(""), F.lit("")))
    ways = {"microdata": r'itemprop="gtin(?:8|12|13|14)?" content="([^"]*)"', "json": r'"gtin(?:8|12|13|14)?"\s*:\s*"([^"]*)"'}
    found = F.create_map(*(x for name, p in ways.items() for x in (F.lit(name), F.regexp_extract_all("html", F.lit(p)))))
    f = load(spark, sf_dir, "pages").select("page_id", html.alias("html")).select("page_id", F.explode(found).alias("source", "raw")).select("page_id", "source", F.explode("raw").alias("raw"))
    code = identity.gtin(F.col("raw"))
    return f.select("page_id", "source", F.when(code.isNotNull(), identity.gtin14(code)).alias("code")).where("code IS NOT NULL").distinct()
