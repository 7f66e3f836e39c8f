"""Decision rules: ladders, families, conflicts, tiers, proposals, hierarchies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity, stats
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


@R.query(r"""
    WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) WHEN 2 THEN replace(p_brand, '#', ' ') ELSE p_name END AS raw FROM part),
         b AS (SELECT DISTINCT p_brand AS brand FROM part)
    SELECT p_partkey, coalesce(e.brand, c.brand, k.brand) AS brand,
           CASE WHEN e.brand IS NOT NULL THEN 1.0 WHEN c.brand IS NOT NULL THEN 0.95 WHEN k.brand IS NOT NULL THEN 0.8 END::DOUBLE AS confidence
    FROM n LEFT JOIN b e ON e.brand = n.raw LEFT JOIN b c ON lower(c.brand) = lower(n.raw)
    LEFT JOIN b k ON regexp_replace(lower(k.brand), '[^a-z0-9]', '', 'g') = regexp_replace(lower(n.raw), '[^a-z0-9]', '', 'g')""")
def q_brand_ladder(spark, sf_dir):
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_brand")).when(k == 1, F.lower("p_brand")).when(k == 2, F.replace("p_brand", F.lit("#"), F.lit(" "))).otherwise(F.col("p_name"))
    n = p.select("p_partkey", raw.alias("raw"))
    brands = p.select(F.col("p_brand").alias("brand")).distinct()
    # every brand under each of its keys with the tier of the key; the best tier that a name meets wins
    tiers = ((1.0, lambda c: c), (0.95, F.lower), (0.8, identity.compact_key))
    keyed = lambda df, col: df.select("*", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), f(F.col(col)).alias("key")) for t, f in tiers))).alias("k")).select("*", "k.*").drop("k")
    hits = keyed(n, "raw").join(keyed(brands, "brand"), ["tier", "key"], "left")
    best = F.max_by("brand", F.when(F.col("brand").isNotNull(), F.col("tier")))
    return hits.groupBy("p_partkey").agg(best.alias("brand"), F.max(F.when(F.col("brand").isNotNull(), F.col("tier"))).alias("confidence"))


@R.query("""
    WITH a AS (SELECT p_partkey, 'a' AS half, lpad((p_partkey % 501)::VARCHAR, 12, '0') AS code FROM part WHERE p_partkey % 2 = 0),
         b AS (SELECT p_partkey, 'b' AS half, CASE WHEN p_partkey % 3 = 0 THEN lpad((p_partkey % 501)::VARCHAR, 14, '0') ELSE lpad((p_partkey % 501)::VARCHAR, 10, '0') END AS code FROM part WHERE p_partkey % 2 = 1),
         m AS (SELECT p_partkey, half, CASE WHEN length(code) IN (8, 12, 13, 14) THEN lpad(code, 14, '0') ELSE code END AS code FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
         g AS (SELECT code, min(p_partkey) AS class_id, count(*) FILTER (half = 'a') AS n_a, count(*) FILTER (half = 'b') AS n_b,
                      coalesce(min(p_partkey) FILTER (half = 'a'), -1) AS first_a, coalesce(min(p_partkey) FILTER (half = 'b'), -1) AS first_b FROM m GROUP BY 1)
    SELECT m.p_partkey, m.half, m.code, g.class_id, CASE m.half WHEN 'a' THEN g.n_b ELSE g.n_a END AS links, CASE m.half WHEN 'a' THEN g.first_b ELSE g.first_a END AS first
    FROM m JOIN g USING (code)""")
def q_gtin_join(spark, sf_dir):
    """Join of two halves of the parts by code, in any of its lengths: every part of
    both with its half, the code they meet by, the class of that code (its least
    part), its number of links and the first of them or -1. Parts are linked if they
    share a class and not a half, so each pair of the join can be told from these
    rows, and their number grows with the parts and not with the pairs."""
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    no, half = (k % 501).cast("string"), F.when(k % 2 == 0, "a").when(k % 2 == 1, "b")
    code = F.when(k % 2 == 0, F.lpad(no, 12, "0")).when(k % 3 == 0, F.lpad(no, 14, "0")).otherwise(F.lpad(no, 10, "0"))
    m = p.select(k, half.alias("half"), code.alias("code")).where("half IS NOT NULL")
    m = m.select(k, "half", F.when(F.length("code").isin(8, 12, 13, 14), identity.gtin14(F.col("code"))).otherwise(F.col("code")).alias("code"))
    of = lambda f, h: f(F.when(F.col("half") == h, k))
    g = m.groupBy("code").agg(
        F.min(k).alias("class_id"), of(F.count, "a").alias("n_a"), of(F.count, "b").alias("n_b"),
        F.coalesce(of(F.min, "a"), F.lit(-1)).alias("first_a"), F.coalesce(of(F.min, "b"), F.lit(-1)).alias("first_b"),
    )
    other = lambda c: F.when(F.col("half") == "a", F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    return m.join(g, "code").select(k, "half", "code", "class_id", other("n").alias("links"), other("first").alias("first"))


@R.query(r"""
    WITH c AS (SELECT DISTINCT regexp_extract(url, '([0-9]{2,})', 1) AS code FROM pages WHERE regexp_matches(url, '[0-9]{2,}')),
         d AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(url, '[0-9]{2,}'))) AS code FROM pages)
    SELECT d.page_id, max(d.code) AS code, count(*) AS hits FROM d JOIN c ON c.code = d.code GROUP BY 1""")
def q_code_in_url(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    codes = p.select(F.regexp_extract("url", "([0-9]{2,})", 1).alias("code")).where("code <> ''").distinct()
    found = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit("([0-9]{2,})")))).alias("code"))
    return found.join(codes, "code").groupBy("page_id").agg(F.max("code").alias("code"), F.count("*").alias("hits"))


@R.query("""
    SELECT doc_id, CASE WHEN c >= 0.8 THEN 'auto' WHEN c >= 0.3 THEN 'review' ELSE 'abstain' END AS tier FROM (SELECT doc_id, least(1.0, n_chars / 4000.0::DOUBLE) AS c FROM documents)""")
def q_review_tiers(spark, sf_dir):
    c = F.least(F.lit(1.0), F.col("n_chars") / 4000.0)
    return load(spark, sf_dir, "documents").select("doc_id", F.when(c >= 0.8, "auto").when(c >= 0.3, "review").otherwise("abstain").alias("tier"))


@R.query(r"""
    WITH f AS (SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)', 1), '') AS t, nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)', 1)), '') AS h,
                      nullif(regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '[^A-Za-z]+', ' ', 'g'), '') AS s FROM pages)
    SELECT page_id, coalesce(h, t, s) AS name, CASE WHEN h IS NOT NULL THEN 'h1' WHEN t IS NOT NULL THEN 'title' WHEN s IS NOT NULL THEN 'slug' END AS source,
           coalesce(lower(h) <> lower(t), false) AS disagree FROM f""")
def q_field_select(spark, sf_dir):
    u, h = F.col("url"), F.col("html")
    some = lambda c: F.when(c != "", c)
    f = load(spark, sf_dir, "pages").select(
        "page_id", some(F.regexp_extract(h, "<title>([^<]*)", 1)).alias("t"), some(F.trim(F.regexp_extract(h, "<h1[^>]*>([^<]*)", 1))).alias("h"),
        some(F.regexp_replace(F.regexp_extract(u, "([^/?#]*)(?:[?#].*)?$", 1), "[^A-Za-z]+", " ")).alias("s"),
    )
    source = F.when(F.col("h").isNotNull(), "h1").when(F.col("t").isNotNull(), "title").when(F.col("s").isNotNull(), "slug")
    return f.select("page_id", F.coalesce("h", "t", "s").alias("name"), source.alias("source"), F.coalesce(F.lower("h") != F.lower("t"), F.lit(False)).alias("disagree"))


@R.query("""
    WITH m AS (SELECT p_brand || '/' || p_type AS family, p_partkey, p_size, p_retailprice FROM part),
         g AS (SELECT family, count(*) AS n, count(*) FILTER (p_size <= 0) AS unknown, count(*) - count(DISTINCT p_size) AS repeated,
                      max(p_retailprice) - min(p_retailprice) AS spread, min(p_size * 1000000 + p_partkey) % 1000000 AS main FROM m GROUP BY 1)
    SELECT family, CASE WHEN n < 2 THEN 'too_few' WHEN unknown > 0 THEN 'unknown_size' WHEN repeated > 0 THEN 'duplicate_tuple' WHEN spread > 900 THEN 'price_spread' ELSE 'ok' END AS verdict,
           CASE WHEN unknown = 0 THEN main END AS main FROM g""")
def q_family_rule(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    g = load(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("family")).agg(
        F.count("*").alias("n"), F.count_if(size <= 0).alias("unknown"), (F.count("*") - F.count_distinct(size)).alias("repeated"),
        (F.max("p_retailprice") - F.min("p_retailprice")).alias("spread"), F.min_by(key, F.struct(size, key)).alias("main"),
    )
    verdict = (
        F.when(F.col("n") < 2, "too_few").when(F.col("unknown") > 0, "unknown_size").when(F.col("repeated") > 0, "duplicate_tuple")
        .when(F.col("spread") > 900, "price_spread").otherwise("ok")
    )
    return g.select("family", verdict.alias("verdict"), F.when(F.col("unknown") == 0, F.col("main")).alias("main"))


@R.query("""
    WITH a AS (SELECT l_partkey, l_suppkey % 2 AS kind, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
         t AS (SELECT l_partkey, kind, arg_max(v, (n, v)) AS v FROM a GROUP BY 1, 2)
    SELECT l_partkey, max(v) FILTER (kind = 0) AS official, max(v) FILTER (kind = 1) AS distributor,
           CASE WHEN count(*) < 2 THEN 'single' WHEN count(DISTINCT v) > 1 THEN 'hard' ELSE 'agreed' END AS conflict FROM t GROUP BY 1""")
def q_conflicts(spark, sf_dir):
    votes = load(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 2).alias("kind"), F.col("l_returnflag").alias("v")).agg(F.count("*").alias("n"))
    tops = votes.groupBy("l_partkey", "kind").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col("v")))
    g = tops.groupBy("l_partkey").agg(side(0).alias("official"), side(1).alias("distributor"), F.count("*").alias("n"), F.count_distinct("v").alias("d"))
    return g.select("l_partkey", "official", "distributor", F.when(F.col("n") < 2, "single").when(F.col("d") > 1, "hard").otherwise("agreed").alias("conflict"))


@R.query("""
    WITH s AS (SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'click') AS b, bool_or(event_type = 'purchase') AS c, bool_or(event_type = 'error') AS e
               FROM events GROUP BY 1)
    SELECT count(*) AS users, count(*) FILTER (a) AS viewed, count(*) FILTER (a AND b) AS clicked, count(*) FILTER (a AND b AND c) AS bought,
           CASE WHEN count(*) FILTER (a) > 0 THEN round(count(*) FILTER (a AND b) / count(*) FILTER (a)::DOUBLE, 6) END AS click_rate,
           CASE WHEN count(*) FILTER (a AND b) > 0 THEN round(count(*) FILTER (a AND b AND c) / count(*) FILTER (a AND b)::DOUBLE, 6) END AS buy_rate,
           count(*) FILTER (e AND NOT c) AS lost FROM s""")
def q_funnel(spark, sf_dir):
    did = lambda t: F.bool_or(F.col("event_type") == t)
    s = load(spark, sf_dir, "events").groupBy("user_id").agg(
        did("view").alias("a"), did("click").alias("b"), did("purchase").alias("c"), did("error").alias("e")
    )
    a, b, c, e = (F.col(x) for x in "abce")
    n = F.count_if
    return s.agg(
        F.count("*").alias("users"), n(a).alias("viewed"), n(a & b).alias("clicked"), n(a & b & c).alias("bought"),
        stats.ratio(n(a & b), n(a)).alias("click_rate"), stats.ratio(n(a & b & c), n(a & b)).alias("buy_rate"), n(e & ~c).alias("lost"),
    )


@R.query(r"""
    WITH v AS (SELECT v, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN ' ' || p_type ELSE p_type END AS v FROM part) GROUP BY 1),
         f AS (SELECT v, n, 'case_only' AS strategy, lower(v) AS form, 0.95 AS confidence FROM v UNION ALL SELECT v, n, 'trim', trim(v), 0.99 FROM v),
         c AS (SELECT *, first_value(v) OVER (PARTITION BY strategy, form ORDER BY n DESC, v) AS canonical FROM f)
    SELECT strategy, v AS old_value, canonical AS new_value, n, confidence::DOUBLE AS confidence FROM c WHERE v <> canonical""")
def q_normalization(spark, sf_dir):
    k, t = F.col("p_partkey") % 3, F.col("p_type")
    v = F.when(k == 0, F.upper(t)).when(k == 1, F.concat(F.lit(" "), t)).otherwise(t)
    counts = load(spark, sf_dir, "part").groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    forms = (("case_only", F.lower("v"), 0.95), ("trim", F.trim("v"), 0.99))
    each = counts.select("v", "n", F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), f.alias("form"), F.lit(c).alias("confidence")) for s, f, c in forms))).alias("f")).select("v", "n", "f.*")
    best = each.groupBy("strategy", "form").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("new_value"))
    return each.join(best, ["strategy", "form"]).where("v <> new_value").select("strategy", F.col("v").alias("old_value"), "new_value", "n", "confidence")


@R.query("""
    WITH s AS (SELECT field, count(DISTINCT v) AS d, count(*) AS n, count(*) FILTER (v LIKE '%-%') AS hyphens, count(*) FILTER (v LIKE '%#%') AS hashes FROM (
        SELECT 'p_brand' AS field, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part) GROUP BY 1)
    SELECT field, d, n, CASE WHEN d <= 10 THEN 'controlled' WHEN d <= n / 20 THEN 'single' ELSE 'free' END AS mode, hyphens, hashes FROM s""")
def q_value_mode(spark, sf_dir):
    v = load(spark, sf_dir, "part").unpivot([], ["p_brand", "p_type", "p_name"], "field", "v")
    s = v.groupBy("field").agg(F.count_distinct("v").alias("d"), F.count("*").alias("n"), F.count_if(F.col("v").contains("-")).alias("hyphens"), F.count_if(F.col("v").contains("#")).alias("hashes"))
    mode = F.when(F.col("d") <= 10, "controlled").when(F.col("d") <= F.col("n") / 20, "single").otherwise("free")
    return s.select("field", "d", "n", mode.alias("mode"), "hyphens", "hashes")


@R.query("""
    WITH p AS (SELECT source, min(doc_id) AS first FROM documents WHERE lang = 'en' GROUP BY 1)
    SELECT l.doc_id, coalesce(p.first, -1) AS predicted_by FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN p ON p.source = d.source""")
def q_first_wins(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    first = docs.where("lang = 'en'").groupBy("source").agg(F.min("doc_id").alias("predicted_by"))
    gold = load(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id")
    return gold.join(first, "source", "left").select("doc_id", F.coalesce("predicted_by", F.lit(-1)).alias("predicted_by"))


@R.query("""
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + 100 AS version FROM orders WHERE o_orderstatus = 'F'""")
def q_version_sequence(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", (n.cast("long") + 100).alias("version"))


@R.query("""
    WITH RECURSIVE t(id, root, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_suppkey < 3
        UNION ALL SELECT s.s_suppkey, t.root, t.depth + 1 FROM supplier s JOIN t ON (s.s_suppkey - 3) // 3 = t.id AND s.s_suppkey >= 3)
    SELECT id, root, depth::INTEGER AS depth FROM t""")
def q_tree_closure(spark, sf_dir):
    return spark.sql("""
        WITH RECURSIVE t(id, root, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM {nodes} WHERE s_suppkey < 3
            UNION ALL SELECT s.s_suppkey, t.root, t.depth + 1 FROM {nodes} s JOIN t ON (s.s_suppkey - 3) DIV 3 = t.id AND s.s_suppkey >= 3)
        SELECT id, root, depth FROM t""", nodes=load(spark, sf_dir, "supplier"))


@R.query("""
    WITH s AS (SELECT vec_id, list_transform(generate_series(0, 62), lambda i: CASE WHEN (i % 8) < 7 THEN CASE WHEN embedding[i::INTEGER + 1] > embedding[i::INTEGER + 2] THEN '1' ELSE '0' END ELSE '' END) AS b FROM embeddings)
    SELECT vec_id, array_to_string(b, '') AS bits FROM s""")
def q_difference_hash(spark, sf_dir):
    """Bits of whether each cell of an 8 by 8 grid is above its right neighbour."""
    v = F.col("embedding")
    bits = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.when(i % 8 < 7, F.when(F.get(v, i) > F.get(v, i + 1), "1").otherwise("0")).otherwise(""))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.array_join(bits, "").alias("bits"))


@R.query("""
    WITH h AS (SELECT source AS domain, count(*) FILTER (doc_id % 2 = 0) AS previous, count(*) FILTER (doc_id % 2 = 1 AND n_chars > 800) AS current FROM documents GROUP BY 1)
    SELECT domain, previous, current, CASE WHEN current = 0 THEN 'zero_product_urls' WHEN previous > 50 AND current < 0.5 * previous THEN 'large_url_drop'
        WHEN previous > 20 AND current > 3 * previous THEN 'large_url_spike' ELSE 'healthy' END AS health FROM h""")
def q_source_health(spark, sf_dir):
    k = F.col("doc_id") % 2
    h = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("domain")).agg(
        F.count_if(k == 0).alias("previous"), F.count_if((k == 1) & (F.col("n_chars") > 800)).alias("current")
    )
    p, c = F.col("previous"), F.col("current")
    health = F.when(c == 0, "zero_product_urls").when((p > 50) & (c < 0.5 * p), "large_url_drop").when((p > 20) & (c > 3 * p), "large_url_spike").otherwise("healthy")
    return h.select("domain", "previous", "current", health.alias("health"))


@R.query("""
    SELECT count(*) AS pruned, min(event_id) AS first_event, max(ts) AS newest FROM (SELECT event_id, ts, event_type,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 20 AND event_type <> 'error'""")
def q_retention(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    old = load(spark, sf_dir, "events").withColumn("rn", rank).where("rn > 20 AND event_type <> 'error'")
    return old.agg(F.count("*").alias("pruned"), F.min("event_id").alias("first_event"), F.max("ts").alias("newest"))


@R.query("""
    WITH o AS (SELECT d.source AS model, l.quality, d.text, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
         g AS (SELECT model, count(*)::DOUBLE AS n, (count(*) FILTER ((quality = 1) = (text NOT LIKE '%!!%')))::DOUBLE AS k, quantile_disc(n_chars, 0.95)::BIGINT AS p95 FROM o GROUP BY 1)
    SELECT model, n::BIGINT AS n, round(k / n, 6) AS match_rate, p95, n >= 30 AND k / n >= 0.9 AS passes FROM g""")
def q_field_report(spark, sf_dir):
    o = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    hit = (F.col("quality") == 1) == ~F.col("text").contains("!!")
    g = o.groupBy(F.col("source").alias("model")).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("k"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("p95")
    )
    rate = F.col("k") / F.col("n")
    return g.select("model", "n", F.round(rate, 6).alias("match_rate"), "p95", ((F.col("n") >= 30) & (rate >= 0.9)).alias("passes"))
