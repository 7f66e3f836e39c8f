"""Merging of sources, row checks, value normalisers and retrieval ladders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity, stats, url
from ..operators import retrieval
from ..sources.tables import load
from .registry import Registry
from .scalar import _TRACKED, _key_sql

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


# --- joins and merges


@R.query("""
    WITH cur AS (SELECT o_custkey, max(o_orderkey) AS snapshot, count(*) AS revision FROM orders GROUP BY 1),
         snap AS (SELECT o_orderkey, o_custkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS revision FROM orders)
    SELECT c.c_custkey, cur.snapshot, s.o_orderstatus AS status FROM customer c LEFT JOIN cur ON cur.o_custkey = c.c_custkey
    LEFT JOIN snap s ON s.o_custkey = cur.o_custkey AND s.o_orderkey = cur.snapshot AND s.revision = cur.revision AND s.o_orderstatus <> 'P'""")
def q_two_hop_left(spark, sf_dir):
    """Customers, the order their pointer names, and its row unless that is pending."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    pointer = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("snapshot"))
    rows = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("snapshot"), F.col("o_orderstatus").alias("status"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(pointer, "c_custkey", "left").join(rows, ["c_custkey", "snapshot"], "left")


@R.query("""
    WITH new AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 END AS s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0)
    SELECT s.s_suppkey, coalesce(n.s_name, s.s_name) AS s_name, coalesce(n.s_acctbal, s.s_acctbal)::DOUBLE AS s_acctbal, n.s_suppkey IS NOT NULL AS touched
    FROM supplier s LEFT JOIN new n ON n.s_suppkey = s.s_suppkey""")
def q_coalescing_update(spark, sf_dir):
    """An update whose nulls leave the old values as they are."""
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    new = s.where(k % 3 != 0).select(
        k, F.when(k % 2 == 0, F.upper("s_name")).alias("new_name"), F.when(k % 5 == 0, 0.0).alias("new_bal"), F.lit(True).alias("hit")
    )
    return s.join(new, "s_suppkey", "left").select(
        k, F.coalesce("new_name", "s_name").alias("s_name"), F.coalesce("new_bal", "s_acctbal").alias("s_acctbal"), F.col("hit").isNotNull().alias("touched")
    )


@R.query(f"""
    WITH e AS (SELECT page_id, url, {_key_sql(_TRACKED)} AS k, CASE WHEN page_id % 3 <> 0 THEN page_id * 7 % 1000 END AS lastmod FROM pages)
    SELECT k, min(page_id) AS first_page, arg_min(url, page_id) AS url, coalesce(arg_min(lastmod, page_id) FILTER (lastmod IS NOT NULL), -1) AS lastmod, count(*) AS entries FROM e GROUP BY 1""")
def q_url_dedupe(spark, sf_dir):
    """Entries of one address as the first of them, with the first date that any has."""
    p = load(spark, sf_dir, "pages").select("page_id", "url", url.identity_key(F.col("url")).alias("k"), F.when(F.col("page_id") % 3 != 0, F.col("page_id") * 7 % 1000).alias("lastmod"))
    dated = F.min_by("lastmod", F.when(F.col("lastmod").isNotNull(), F.col("page_id")))
    return p.groupBy("k").agg(F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("url"), F.coalesce(dated, F.lit(-1)).alias("lastmod"), F.count("*").alias("entries"))


@R.query("""
    WITH c AS (SELECT l_partkey AS id, 1 AS source, count(*)::DOUBLE AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
               UNION ALL SELECT p_partkey, 2, p_size::DOUBLE FROM part WHERE p_size > 10)
    SELECT id, min(source) AS source, arg_min(score, source) AS score FROM c GROUP BY 1""")
def q_pool_union(spark, sf_dir):
    """Candidates of two sources; the first source that has one wins."""
    a = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.lit(1).alias("source"), F.count("*").cast("double").alias("score"))
    b = load(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit(2).alias("source"), F.col("p_size").cast("double").alias("score"))
    return a.unionByName(b).groupBy("id").agg(F.min("source").alias("source"), F.min_by("score", "source").alias("score"))


@R.query("""
    SELECT p_partkey, p_type FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, length(p_type) ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""")
def q_first_of_length(spark, sf_dir):
    """The first part of each brand among those with names of one length."""
    g = load(spark, sf_dir, "part").groupBy("p_brand", F.length("p_type")).agg(F.min_by(F.struct("p_partkey", "p_type"), "p_partkey").alias("f"))
    return g.select("f.*")


# --- checks


@R.query("""
    SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 HAVING count(*) > 1""")
def q_partial_unique(spark, sf_dir):
    """Keys that break a unique rule which holds for open rows only."""
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 1")


@R.query("""
    SELECT rule, count(*) AS broken, min(l_orderkey) AS first_key FROM (SELECT l_orderkey, unnest(list_filter([
        CASE WHEN NOT l_returnflag IN ('A', 'N') THEN 'flag' END, CASE WHEN NOT (l_discount >= 0 AND l_discount <= 0.08) THEN 'discount' END,
        CASE WHEN NOT (l_quantity > 0 AND l_quantity <= 45) THEN 'quantity' END, CASE WHEN NOT (l_linestatus <> 'F' OR l_tax < 0.07) THEN 'tax' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY 1""")
def q_domain_checks(spark, sf_dir):
    """Rows outside the domains that columns are declared to have, by rule; null breaks none."""
    c = F.col
    rules = {
        "flag": c("l_returnflag").isin("A", "N"), "discount": c("l_discount").between(0, 0.08), "quantity": (c("l_quantity") > 0) & (c("l_quantity") <= 45),
        "tax": (c("l_linestatus") != "F") | (c("l_tax") < 0.07),
    }
    broken = F.array_compact(F.array(*(F.when(~ok, F.lit(k)) for k, ok in rules.items())))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("broken"), F.min("l_orderkey").alias("first_key"))


@R.query("""
    WITH v AS (SELECT p_partkey, concat_ws(',', CASE WHEN trim(coalesce(p_name, '')) = '' THEN 'error:name' END, CASE WHEN p_retailprice IS NULL OR p_retailprice <= 0 THEN 'error:price' END,
                    CASE WHEN p_retailprice > 1800 THEN 'warning:price' END, CASE WHEN length(p_name) < 8 THEN 'warning:name' END, CASE WHEN p_size = 1 THEN 'info:size' END) AS issues FROM part)
    SELECT p_partkey, issues, CASE WHEN issues LIKE '%error:%' THEN 'blocked' WHEN issues LIKE '%warning:%' THEN 'review' ELSE 'ok' END AS outcome FROM v""")
def q_product_checks(spark, sf_dir):
    """Issues of each part with their severities; the worst decides."""
    name, price = F.col("p_name"), F.col("p_retailprice")
    rules = {
        "error:name": F.trim(F.coalesce(name, F.lit(""))) == "", "error:price": price.isNull() | (price <= 0), "warning:price": price > 1800,
        "warning:name": F.length(name) < 8, "info:size": F.col("p_size") == 1,
    }
    v = load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", *(F.when(c, k) for k, c in rules.items())).alias("issues"))
    worst = F.when(F.col("issues").contains("error:"), "blocked").when(F.col("issues").contains("warning:"), "review").otherwise("ok")
    return v.withColumn("outcome", worst)


@R.query("""
    SELECT label, count(*) AS n, count(*) FILTER (vec_id % 5 = 0) AS held, count(*) >= 20 AND count(*) FILTER (vec_id % 5 = 0) >= 5 AS supported FROM embeddings GROUP BY 1""")
def q_class_support(spark, sf_dir):
    """Whether each class has rows enough to be scored, in all and held out."""
    n, held = F.count("*"), F.count_if(F.col("vec_id") % 5 == 0)
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(n.alias("n"), held.alias("held"), ((n >= 20) & (held >= 5)).alias("supported"))


@R.query("""
    WITH r AS (SELECT user_id, event_id, event_type, ts, (SELECT max(ts) FROM events) AS now FROM events)
    SELECT event_type, count(*) FILTER (ts > now - INTERVAL 7 DAY) AS fresh, count(*) FILTER (ts <= now - INTERVAL 7 DAY) AS expired,
           max(event_id) FILTER (ts <= now - INTERVAL 7 DAY) AS last_expired FROM r GROUP BY 1""")
def q_ttl(spark, sf_dir):
    """Cached rows that are still valid at the newest time, and those past their life."""
    e = load(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    live = F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")
    return e.join(F.broadcast(now)).groupBy("event_type").agg(
        F.count_if(live).alias("fresh"), F.count_if(~live).alias("expired"), F.max(F.when(~live, F.col("event_id"))).alias("last_expired")
    )


@R.query("""
    WITH s AS (SELECT lang, count(*) AS total, count(*) FILTER (n_chars < 200) AS short, count(*) FILTER (text LIKE '%!!%') AS loud FROM documents GROUP BY 1)
    SELECT lang, total, short, loud, CASE WHEN short + loud = 0 THEN 'healthy' WHEN (short + loud) / total::DOUBLE > 0.3 THEN 'failing' ELSE 'attention' END AS health FROM s""")
def q_category_health(spark, sf_dir):
    s = load(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("total"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(F.col("text").contains("!!")).alias("loud")
    )
    bad = F.col("short") + F.col("loud")
    return s.withColumn("health", F.when(bad == 0, "healthy").when(bad / F.col("total") > 0.3, "failing").otherwise("attention"))


@R.query("""
    SELECT p_type, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey)[1:5], ',') AS samples FROM part GROUP BY 1""")
def q_capped_samples(spark, sf_dir):
    """Counts with the five smallest keys as samples; ranks are cut before keys meet."""
    p = load(spark, sf_dir, "part")
    rank = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    top = p.select("p_type", "p_partkey", rank.alias("rn")).where("rn <= 5").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("samples"))
    return p.groupBy("p_type").agg(F.count("*").alias("n")).join(top, "p_type")


# --- values


@R.query(r"""
    WITH w AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'bag of ' || p_size || ' lbs net' WHEN 1 THEN p_size || '.5 OZ' WHEN 2 THEN 'about ' || p_size WHEN 3 THEN p_size || ' grams' WHEN 4 THEN 'none' ELSE p_size || 'kg x 2' END AS raw FROM part),
         m AS (SELECT p_partkey, regexp_extract(lower(raw), '([0-9]+(\.[0-9]+)?)\s*(lbs?|kg|grams?|g|oz|ounces?|pounds?)\b', 1) AS n,
                      regexp_extract(lower(raw), '([0-9]+(\.[0-9]+)?)\s*(lbs?|kg|grams?|g|oz|ounces?|pounds?)\b', 3) AS u, regexp_extract(raw, '([0-9]+(\.[0-9]+)?)', 1) AS bare FROM w)
    SELECT p_partkey, CASE WHEN n <> '' THEN round(n::DOUBLE * CASE substr(u, 1, 1) WHEN 'l' THEN 1.0 WHEN 'p' THEN 1.0 WHEN 'k' THEN 2.2046226218 WHEN 'g' THEN 0.0022046226218 ELSE 0.0625 END, 2)
                           WHEN bare <> '' THEN round(bare::DOUBLE, 2) END AS pounds FROM m""")
def q_weight_lenient(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("bag of "), size, F.lit(" lbs net"))).when(k == 1, F.concat(size, F.lit(".5 OZ"))).when(k == 2, F.concat(F.lit("about "), size))
        .when(k == 3, F.concat(size, F.lit(" grams"))).when(k == 4, "none").otherwise(F.concat(size, F.lit("kg x 2")))
    )
    return load(spark, sf_dir, "part").select("p_partkey", identity.pounds_lenient(raw).alias("pounds"))


_PRICE = r"""CASE WHEN regexp_matches(replace(trim(raw), ',', ''), '^-?[0-9]+(\.[0-9]+)?$') THEN round(replace(trim(raw), ',', '')::DOUBLE, 6)::VARCHAR WHEN trim(raw) <> '' THEN trim(raw) END"""


@R.query(rf"""
    WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' 1,' || lpad(p_size::VARCHAR, 3, '0') || '.5 ' WHEN 1 THEN p_size || '.25' WHEN 2 THEN 'call' ELSE '  ' END AS raw,
                      '  ' || p_name || chr(10) || '  ' || p_brand || ' ' AS txt FROM part),
         n AS (SELECT p_partkey, {_PRICE} AS price, regexp_replace(trim(txt, chr(10) || ' '), '\s+', ' ', 'g') AS label FROM r)
    SELECT p_partkey, price, label, sha256(coalesce(price, '\N') || '|' || coalesce(label, '\N')) AS h FROM n""")
def q_comparison_hash(spark, sf_dir):
    """Price and text in the form in which two catalogues are compared, and their hash."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" 1,"), F.lpad(size, 3, "0"), F.lit(".5 "))).when(k == 1, F.concat(size, F.lit(".25"))).when(k == 2, "call").otherwise("  ")
    txt = F.concat(F.lit("  "), "p_name", F.lit("\n  "), "p_brand", F.lit(" "))
    n = load(spark, sf_dir, "part").select("p_partkey", identity.price_key(raw).alias("price"), identity.text_key(txt).alias("label"))
    marked = [F.coalesce(c, F.lit("\\N")) for c in ("price", "label")]
    return n.withColumn("h", F.sha2(F.concat_ws("|", *marked), 256))


@R.query("""
    WITH s AS (SELECT DISTINCT p_brand || ' ' || p_type AS a FROM part),
         t AS (SELECT a, string_split(a, ' ') AS w FROM s)
    SELECT x.a AS a, y.a AS b FROM t x JOIN t y ON x.a < y.a AND len(x.w) = len(y.w)
    WHERE len(list_filter(generate_series(1, len(x.w)), lambda i: x.w[i] <> y.w[i])) = 1
      AND len(list_filter(generate_series(1, len(x.w)), lambda i: x.w[i] <> y.w[i] AND length(x.w[i]) >= 4 AND length(y.w[i]) >= 4 AND levenshtein(x.w[i], y.w[i]) <= 1)) = 1""")
def q_typo_names(spark, sf_dir):
    """Names that differ in one word of four letters or more by one edit.

    A name posts itself once for each word with that word left out, so pairs
    meet on what they share and not all with all; the word itself posts its
    pieces with one letter left out, as two words one edit apart share one.
    """
    words = F.split("a", " ")
    names = load(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("a")).distinct().select("a", F.posexplode(words).alias("i", "w")).where(F.length("w") >= 4)
    rest = F.array_join(F.transform(words, lambda x, k: F.when(k != F.col("i"), x).otherwise("\x00")), " ")
    cut = F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.concat(F.substring("w", F.lit(1), k - 1), F.substring("w", k + 1, F.length("w"))))
    posts = names.select("a", "w", rest.alias("rest"), F.explode(F.array_distinct(F.concat(F.array("w"), cut))).alias("piece"))
    x, y = posts, posts.select(F.col("a").alias("b"), F.col("w").alias("v"), "rest", "piece")
    return x.join(y, ["rest", "piece"]).where((F.col("a") < F.col("b")) & (F.levenshtein("w", "v") <= 1)).select("a", "b").distinct()


@R.query("""
    WITH s AS (SELECT l_orderkey, list_distinct(list(l_returnflag || l_linestatus)) AS a, list_distinct(list(l_returnflag || l_linestatus) FILTER (l_linenumber <= 2)) AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE >= 0.5 AS matches FROM s WHERE len(b) > 0""")
def q_array_match(spark, sf_dir):
    """Whether two lists of an order share half of their values or more."""
    v = F.concat("l_returnflag", "l_linestatus")
    s = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(v).alias("a"), F.collect_set(F.when(F.col("l_linenumber") <= 2, v)).alias("b"))
    return s.where(F.size("b") > 0).select("l_orderkey", (retrieval.jaccard(F.col("a"), F.col("b")) >= 0.5).alias("matches"))


@R.query("""
    WITH l AS (SELECT * FROM (VALUES (0.99, 2.576), (0.95, 1.96), (0.9, 1.645), (0.8, 1.282)) v(level, z)),
         s AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
    SELECT event_type, level::DOUBLE AS level, round(m - z::DOUBLE * sd / sqrt(n), 6) AS lower, round(m + z::DOUBLE * sd / sqrt(n), 6) AS upper FROM s, l""")
def q_confidence_levels(spark, sf_dir):
    """Intervals of the mean at each of four levels, from one pass over the rows."""
    s = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    each = s.select("*", F.explode(F.array(*(F.lit(x) for x in (0.99, 0.95, 0.9, 0.8)))).alias("level"))
    half = stats.z_value(F.col("level")) * F.col("sd") / F.sqrt("n")
    return each.select("event_type", "level", F.round(F.col("m") - half, 6).alias("lower"), F.round(F.col("m") + half, 6).alias("upper"))


# --- retrieval


@R.query(r"""
    WITH p AS (SELECT page_id, url, regexp_extract(url, '([0-9]{2,})', 1) AS code, list_distinct(list_filter(string_split_regex(lower(url), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS u,
                      list_distinct(list_filter(string_split_regex(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS t FROM pages),
         s AS (SELECT page_id, code, CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_intersect(u, t)) / len(t)::DOUBLE END AS ratio, regexp_matches(url, '/(p|product|item)s?[/-]') AS pattern, len(t) > 0 AS titled FROM p)
    SELECT page_id, CASE WHEN length(code) >= 4 THEN 'code' WHEN code <> '' THEN 'short_code' WHEN ratio > 0 OR pattern THEN 'lexical' ELSE 'none' END AS tier,
           round(CASE WHEN length(code) >= 4 THEN 0.99 WHEN code <> '' THEN 0.95 WHEN ratio > 0 OR pattern
                      THEN least(0.89, greatest(0.6, 0.65 + 0.2 * ratio + CASE WHEN pattern THEN 0.05 ELSE 0 END + CASE WHEN titled THEN 0.05 ELSE 0 END)) END, 6)::DOUBLE AS confidence FROM s""")
def q_retrieval_ladder(spark, sf_dir):
    """The best tier under which a page is found, with its confidence."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    p = load(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "([0-9]{2,})", 1).alias("code"), words("url").alias("u"), words(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("t"),
        F.col("url").rlike("/(p|product|item)s?[/-]").alias("pattern"),
    )
    p = p.select("page_id", "code", "pattern", (F.size("t") > 0).alias("titled"), F.when(F.size("t") == 0, 0.0).otherwise(F.size(F.array_intersect("u", "t")) / F.size("t")).alias("ratio"))
    point = lambda c: F.when(F.col(c), 0.05).otherwise(0.0)
    score = F.least(F.lit(0.89), F.greatest(F.lit(0.6), 0.65 + 0.2 * F.col("ratio") + point("pattern") + point("titled")))
    long, some, lexical = F.length("code") >= 4, F.col("code") != "", (F.col("ratio") > 0) | F.col("pattern")
    return p.select(
        "page_id", F.when(long, "code").when(some, "short_code").when(lexical, "lexical").otherwise("none").alias("tier"),
        F.round(F.when(long, 0.99).when(some, 0.95).when(lexical, score), 6).alias("confidence"),
    )
