"""Filters, joins, grouping, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diff, keyed
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


@R.query("""
    SELECT o_orderpriority, count(*) AS total,
           count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'O') AS open_orders,
           count(*) FILTER (o_orderstatus = 'P') AS pending,
           round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS hit_rate
    FROM orders GROUP BY o_orderpriority""")
def q_status_rollup(spark, sf_dir):
    def of(status):
        return F.count_if(F.col("o_orderstatus") == status)

    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("total"), of("F").alias("filled"), of("O").alias("open_orders"),
        of("P").alias("pending"), F.round(of("F") / F.count("*"), 6).alias("hit_rate"),
    )


# --- filters and projections


@R.query("""
    SELECT p_partkey, p_name, p_brand FROM part
    WHERE p_name ILIKE '%th%' OR p_brand ILIKE '%#12%' OR p_type ILIKE 'promo%'""")
def q_search_like(spark, sf_dir):
    found = F.col("p_name").ilike("%th%") | F.col("p_brand").ilike("%#12%") | F.col("p_type").ilike("promo%")
    return load(spark, sf_dir, "part").where(found).select("p_partkey", "p_name", "p_brand")


@R.query(r"SELECT doc_id, n_chars FROM documents WHERE text LIKE '%\%%' ESCAPE '\' AND text NOT LIKE '%\_\_%' ESCAPE '\'")
def q_like_escaped(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").where(t.contains("%") & ~t.contains("__")).select("doc_id", "n_chars")


@R.query("""
    SELECT CASE WHEN p_size IS NULL OR p_size <= 10 THEN 'out' WHEN p_size <= 25 THEN 'low' ELSE 'in' END AS tier,
           count(*) AS n, round(avg(p_retailprice), 6) AS mean_price, count(*) FILTER (p_retailprice >= 1200) AS dear
    FROM part GROUP BY 1""")
def q_price_tiers(spark, sf_dir):
    size = F.col("p_size")
    tier = F.when(size.isNull() | (size <= 10), "out").when(size <= 25, "low").otherwise("in")
    return load(spark, sf_dir, "part").groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"),
        F.count_if(F.col("p_retailprice") >= 1200).alias("dear"),
    )


@R.query("""
    SELECT event_id, user_id, value FROM events
    WHERE event_type = 'purchase' AND value >= 50 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def q_conjunctive_filter(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.where("event_type = 'purchase' AND value >= 50").where(
        (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    ).select("event_id", "user_id", "value")


@R.query("""
    SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events
    WHERE json_extract_string(props, '$.k') LIKE '1%'""")
def q_json_path_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return load(spark, sf_dir, "events").where(k.like("1%")).select("event_id", k.cast("int").alias("k"))


@R.query("""
    SELECT p_partkey, coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE), 0) AS brand_no FROM part
    WHERE coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE), 0) BETWEEN 3 AND 9""")
def q_lenient_cast(spark, sf_dir):
    no = F.coalesce(F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("double"), F.lit(0.0))
    return load(spark, sf_dir, "part").select("p_partkey", no.alias("brand_no")).where("brand_no BETWEEN 3 AND 9")


@R.query("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS rank,
           CASE WHEN o_totalprice IS NULL THEN 0 ELSE 1 END AS has_price
    FROM orders ORDER BY 2 DESC, o_orderdate DESC, o_orderkey LIMIT 50""")
def q_case_order(spark, sf_dir):
    status = F.col("o_orderstatus")
    rank = F.when(status == "P", 3).when(status == "O", 2).otherwise(1)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", rank.alias("rank"), F.col("o_totalprice").isNotNull().cast("int").alias("has_price"), "o_orderdate"
    ).orderBy(F.desc("rank"), F.desc("o_orderdate"), "o_orderkey").limit(50).drop("o_orderdate")


@R.query("""
    WITH t AS (SELECT CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'x' ELSE 'y' END AS species, p_type, p_partkey FROM part),
         bad AS (SELECT * FROM (VALUES ('x', 'PROMO'), ('y', 'LARGE')) v(species, term))
    SELECT p_partkey, p_type FROM t WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.species = t.species AND bad.term = t.p_type)""")
def q_species_guard(spark, sf_dir):
    species = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "x").otherwise("y")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_type", species.alias("species"))
    bad = spark.createDataFrame([("x", "PROMO"), ("y", "LARGE")], "species string, p_type string")
    return parts.join(F.broadcast(bad), ["species", "p_type"], "left_anti").select("p_partkey", "p_type")


# --- joins


@R.query("""
    SELECT n.n_name, count(*) AS n_lines, sum(floor(l.l_extendedprice * (1 - l.l_discount) * 100)::BIGINT)::BIGINT AS revenue_cents
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey
    WHERE l.l_shipdate >= TIMESTAMP '1995-01-01' AND l.l_shipdate < TIMESTAMP '1997-01-01' GROUP BY n.n_name""")
def q_inner_chain(spark, sf_dir):
    l, o, c, n = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    l = l.where("l_shipdate >= timestamp'1995-01-01' AND l_shipdate < timestamp'1997-01-01'")
    joined = (
        l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)
    return joined.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.sum(cents).alias("revenue_cents"))


@R.query("""
    SELECT c.c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(o.filled, 0) AS filled, round(coalesce(o.total, 0), 2) AS total
    FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS filled,
        sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def q_batch_rollup_left(spark, sf_dir):
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.sum("o_totalprice").alias("t")
    )
    return load(spark, sf_dir, "customer").join(o, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("f", F.lit(0)).alias("filled"),
        F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"),
    )


@R.query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def q_orphans_left_null(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@R.query("""
    SELECT l_orderkey, l_linenumber FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 2)
       OR NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0)""")
def q_orphans_multi(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    p = load(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("has_part"))
    s = load(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("has_supp"))
    return l.join(p, "l_partkey", "left").join(s, "l_suppkey", "left").where("has_part IS NULL OR has_supp IS NULL").select(
        "l_orderkey", "l_linenumber"
    )


@R.query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_semi_in(spark, sf_dir):
    c = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@R.query("""
    SELECT event_id FROM events e WHERE EXISTS (
        SELECT 1 FROM part p WHERE p.p_partkey = json_extract_string(e.props, '$.k')::BIGINT AND p.p_size >= 25)""")
def q_semi_exists_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    p = load(spark, sf_dir, "part").where("p_size >= 25").select(F.col("p_partkey").alias("k"))
    return load(spark, sf_dir, "events").select("event_id", k.alias("k")).join(p, "k", "left_semi").select("event_id")


@R.query("""
    SELECT o_orderkey FROM orders o WHERE o_orderpriority = '1-URGENT'
        OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)""")
def q_or_semi(spark, sf_dir):
    big = load(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("big")).distinct()
    return load(spark, sf_dir, "orders").join(big, "o_orderkey", "left").where("o_orderpriority = '1-URGENT' OR big").select("o_orderkey")


@R.query("""
    SELECT o.o_custkey, o.o_orderkey FROM orders o JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) m
    ON m.o_custkey = o.o_custkey AND m.d = o.o_orderdate""")
def q_latest_self_join(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    latest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return o.join(latest, ["o_custkey", "o_orderdate"]).select("o_custkey", "o_orderkey")


@R.query("""
    SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b
    ON lower(a.s_name) = lower(b.s_name) AND a.s_nationkey = b.s_nationkey AND a.s_suppkey <= b.s_suppkey""")
def q_column_equality(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.lower("s_name").alias("name"), "s_nationkey")
    a, b = s.withColumnRenamed("s_suppkey", "a"), s.withColumnRenamed("s_suppkey", "b")
    return a.join(b, ["name", "s_nationkey"]).where("a <= b").select("a", "b")


@R.query("""
    SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS a, l_suppkey % 5 AS b FROM lineitem)
    WHERE (a, b) NOT IN (SELECT * FROM (VALUES (0, 0), (1, 3), (6, 4)) v)""")
def q_acknowledged(spark, sf_dir):
    acks = spark.createDataFrame([(0, 0), (1, 3), (6, 4)], "a long, b long")
    hunks = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).alias("a"), (F.col("l_suppkey") % 5).alias("b"))
    return hunks.join(F.broadcast(acks), ["a", "b"], "left_anti").select("l_orderkey", "l_linenumber")


# --- grouping


@R.query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 5")
def q_having(spark, sf_dir):
    return load(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 5")


@R.query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 100")
def q_topn_group(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(100)


@R.query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def q_count_distinct(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@R.query("SELECT DISTINCT json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def q_distinct_json(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k")).distinct()


@R.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def q_two_key_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@R.query("""
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
           count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def q_count_matrix(spark, sf_dir):
    wide = load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"))


@R.query("SELECT lang, count(*) AS n_rows, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY 1")
def q_len_sum(spark, sf_dir):
    size = F.length(F.coalesce("text", F.lit("")))
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum(size).alias("chars"))


@R.query("""
    SELECT max(d) AS watermark FROM (SELECT max(ts) AS d FROM events UNION ALL SELECT max(o_orderdate) FROM orders
        UNION ALL SELECT max(l_shipdate) FROM lineitem)""")
def q_union_watermark(spark, sf_dir):
    tops = [load(spark, sf_dir, t).agg(F.max(c).alias("d")) for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return tops[0].unionByName(tops[1]).unionByName(tops[2]).agg(F.max("d").alias("watermark"))


@R.query("""
    SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending,
           (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM part WHERE p_size > 40) AS large_parts,
           (SELECT count(DISTINCT user_id) FROM events) AS users""")
def q_dashboard(spark, sf_dir):
    o = load(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    c = load(spark, sf_dir, "customer").agg(F.count("*").alias("customers"))
    p = load(spark, sf_dir, "part").agg(F.count_if(F.col("p_size") > 40).alias("large_parts"))
    e = load(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"))
    one = [d.withColumn("one", F.lit(1)) for d in (o, c, p, e)]  # single rows
    return one[0].join(one[1], "one").join(one[2], "one").join(one[3], "one").drop("one")


@R.query("SELECT user_id, min(ts) AS first_at, coalesce(max(event_id), 0) AS last_seq, count(*) AS n FROM events GROUP BY 1")
def q_min_per_group(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("first_at"), F.coalesce(F.max("event_id"), F.lit(0)).alias("last_seq"), F.count("*").alias("n")
    )


# --- windows, order and paging


@R.query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_per_key(spark, sf_dir):
    return keyed.latest(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@R.query("""
    SELECT user_id, event_id, value FROM events WHERE event_type <> 'error'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_latest_live(spark, sf_dir):
    live = load(spark, sf_dir, "events").where("event_type <> 'error'")
    return keyed.latest(live, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@R.query("""
    SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE p_size BETWEEN 10 AND 30
    ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50""")
def q_page(spark, sf_dir):
    return keyed.page(load(spark, sf_dir, "part").where("p_size BETWEEN 10 AND 30").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 50, 25)


@R.query("""
    SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-15 00:00:00', 100)
    ORDER BY ts, event_id LIMIT 50""")
def q_keyset(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "ts")
    return keyed.after(e, {"ts": F.lit("2024-01-15 00:00:00").cast("timestamp"), "event_id": F.lit(100)}, 50)


@R.query("""
    SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome
    FROM documents""")
def q_first_later(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    first = first.withColumnRenamed("h", "g")  # null texts are one group
    return docs.join(first, F.col("h").eqNullSafe(F.col("g"))).select("doc_id", F.when(F.col("doc_id") == F.col("first"), "accepted").otherwise("duplicate").alias("outcome"))


@R.query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def q_exact_first(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@R.query(r"""
    SELECT md5(regexp_replace(lower(text), '\s+', ' ', 'g')) AS entity, arg_min(doc_id, source || '|' || lpad(doc_id::VARCHAR, 12, '0')) AS doc_id,
           min(source || '|' || lpad(doc_id::VARCHAR, 12, '0')) AS sort_key FROM documents GROUP BY 1""")
def q_silver_repr(spark, sf_dir):
    key = F.concat("source", F.lit("|"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    entity = F.md5(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return load(spark, sf_dir, "documents").groupBy(entity.alias("entity")).agg(F.min_by("doc_id", key).alias("doc_id"), F.min(key).alias("sort_key"))


@R.query("""
    SELECT p_partkey, CASE WHEN rn = 1 THEN stem ELSE stem || '-' || rn::VARCHAR END AS file_name FROM (
        SELECT p_partkey, stem, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS rn FROM (
            SELECT p_partkey, substr(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), 1, 80) AS stem FROM part))""")
def q_uniquify(spark, sf_dir):
    stem = F.substring(F.regexp_replace(F.lower(F.concat_ws(" ", "p_type", "p_brand")), "[^a-z0-9]+", "-"), 1, 80)
    return keyed.uniquify(load(spark, sf_dir, "part").select("p_partkey", stem.alias("stem")), "stem", "p_partkey", "file_name").select("p_partkey", "file_name")


# --- set operations, differences and reconciliation

_CHANGED = """SELECT p_partkey AS k, p_brand AS brand, CASE WHEN p_partkey % 10 = 0 THEN 'EDITED' ELSE p_type END AS type,
    CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 11 <> 0"""


def _versions(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    old = p.select(k.alias("k"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
    new = p.where(k % 11 != 0).select(
        k.alias("k"), F.col("p_brand").alias("brand"), F.when(k % 10 == 0, "EDITED").otherwise(F.col("p_type")).alias("type"),
        F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string").alias("size"),
    )
    return old, new


@R.query(f"""
    WITH old AS (UNPIVOT (SELECT p_partkey AS k, p_brand AS brand, p_type AS type, p_size::VARCHAR AS size FROM part) ON brand, type, size INTO NAME field VALUE v),
         new AS (UNPIVOT (SELECT k, brand, type, size::VARCHAR AS size FROM ({_CHANGED})) ON brand, type, size INTO NAME field VALUE v)
    SELECT coalesce(o.k, n.k) AS k, coalesce(o.field, n.field) AS field, o.v AS before, n.v AS after,
           CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old o FULL JOIN new n ON o.k = n.k AND o.field = n.field WHERE o.v IS DISTINCT FROM n.v""")
def q_projection_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return diff.fields(old, new, "k", ["brand", "type", "size"])


@R.query("""
    WITH old AS (SELECT url FROM pages WHERE page_id % 2 = 0), new AS (SELECT url FROM pages WHERE page_id % 3 = 0)
    SELECT CASE WHEN o.url IS NULL THEN 'inserted' WHEN n.url IS NULL THEN 'deactivated' ELSE 'refreshed' END AS outcome, count(*) AS n
    FROM (SELECT DISTINCT url FROM old) o FULL JOIN (SELECT DISTINCT url FROM new) n ON o.url = n.url GROUP BY 1""")
def q_reconcile(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return diff.reconcile(p.where("page_id % 2 = 0").select("url"), p.where("page_id % 3 = 0").select("url"), "url").groupBy("outcome").agg(F.count("*").alias("n"))


@R.query("""
    WITH cur AS (SELECT vec_id, label AS model, vec_id % 4 AS h, vec_id % 50 AS age FROM embeddings WHERE vec_id % 3 <> 0),
         want AS (SELECT vec_id, label AS model, CASE WHEN vec_id % 5 = 0 THEN 9 ELSE vec_id % 4 END AS h FROM embeddings WHERE vec_id % 7 <> 0)
    SELECT coalesce(c.vec_id, w.vec_id) AS vec_id,
           CASE WHEN c.vec_id IS NULL THEN 'upsert' WHEN w.vec_id IS NOT NULL AND c.h = w.h THEN 'noop' WHEN w.vec_id IS NOT NULL THEN 'upsert'
                WHEN c.model <> 1 AND c.age <= 30 THEN 'tombstone' ELSE 'delete' END AS action
    FROM cur c FULL JOIN want w ON c.vec_id = w.vec_id""")
def q_sync_plan(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    cur = e.where(k % 3 != 0).select(k, F.col("label").alias("model"), (k % 4).alias("h"), (k % 50).alias("age"))
    want = e.where(k % 7 != 0).select(k, F.when(k % 5 == 0, 9).otherwise(k % 4).alias("h"))
    return diff.sync_plan(cur, want, "vec_id", "h", stale=(F.col("model") == 1) | (F.col("age") > 30))


@R.query("""
    WITH a AS (SELECT l_suppkey, list_sort(list(DISTINCT l_partkey % 40)) AS s FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY 1),
         b AS (SELECT l_suppkey, list_sort(list(DISTINCT l_partkey % 40)) AS s FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1)
    SELECT a.l_suppkey, array_to_string(list_filter(b.s, lambda x: NOT list_contains(a.s, x)), ',') AS added,
           array_to_string(list_filter(a.s, lambda x: NOT list_contains(b.s, x)), ',') AS removed FROM a JOIN b ON a.l_suppkey = b.l_suppkey""")
def q_set_delta(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), (F.col("l_partkey") % 40).alias("p"))
    sets = [l.where(f"y = {y}").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("p")).alias(f"s{y}")) for y in (1995, 1996)]
    both = sets[0].join(sets[1], "l_suppkey")
    text = lambda a, b: F.array_join(F.array_except(a, b), ",")
    return both.select("l_suppkey", text("s1996", "s1995").alias("added"), text("s1995", "s1996").alias("removed"))


@R.query("""
    SELECT 'nation' AS tbl, count(*) AS n_rows, bit_xor(h)::BIGINT AS x, (sum(h % 1000003))::BIGINT AS s FROM (
        SELECT ('0x' || substr(sha256(n_nationkey::VARCHAR || '|' || n_name || '|' || n_regionkey::VARCHAR), 1, 15))::BIGINT AS h FROM nation)
    UNION ALL SELECT 'part', count(*), bit_xor(h)::BIGINT, (sum(h % 1000003))::BIGINT FROM (
        SELECT ('0x' || substr(sha256(p_partkey::VARCHAR || '|' || p_name || '|' || p_brand), 1, 15))::BIGINT AS h FROM part)""")
def q_table_digest(spark, sf_dir):
    n = diff.digest(load(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], "nation")
    return n.unionByName(diff.digest(load(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand"], "part"))


@R.query("""
    SELECT user_id, event_id, event_type, value, 'update' AS change FROM (SELECT * FROM events WHERE event_id % 3 = 0
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) s
    WHERE EXISTS (SELECT 1 FROM events t WHERE t.event_id % 3 = 1 AND t.user_id = s.user_id AND t.event_type = s.event_type)
    UNION ALL
    SELECT user_id, event_id, event_type, value, 'insert' FROM (SELECT * FROM events WHERE event_id % 3 = 0
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) s
    WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.event_id % 3 = 1 AND t.user_id = s.user_id AND t.event_type = s.event_type)
    UNION ALL
    SELECT user_id, event_id, event_type, value, 'keep' FROM (SELECT * FROM events WHERE event_id % 3 = 1
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) t
    WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 3 = 0 AND s.user_id = t.user_id AND s.event_type = t.event_type)""")
def q_upsert(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    key = ["user_id", "event_type"]
    old, new = (keyed.latest(e.where(f"event_id % 3 = {k}"), key, ["ts", "event_id"]) for k in (1, 0))
    return keyed.upsert(old, new, key).select("user_id", "event_id", "event_type", "value", "change")


@R.query("""
    WITH r AS (SELECT value AS v, count(*) AS n FROM (SELECT round(value) AS value FROM events) GROUP BY 1)
    SELECT v, n, round(n / sum(n) OVER (), 6) AS share, sum(n) OVER (ORDER BY v)::BIGINT AS running FROM r""")
def q_reason_share(spark, sf_dir):
    counts = load(spark, sf_dir, "events").groupBy(F.round("value").alias("v")).agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("v") / 256))
    # sums run within blocks of 256 values; only one row for each block is ordered as a whole
    blocks = counts.groupBy(F.col("block").alias("b")).agg(F.sum("n").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("b", before.alias("before"), F.sum("sum").over(Window.partitionBy()).alias("total"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("v"))
    return counts.join(blocks, F.col("block").eqNullSafe(F.col("b"))).select(
        "v", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("before") + within).alias("running")
    )
