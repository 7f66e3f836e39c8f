"""Quality, calibration and comparison metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators.audit import duplicate_groups, field_stats, near_values
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


@R.query("""
    SELECT d.source, count(*) AS n, count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS unchanged, count(*) FILTER (l.toxic = 1) AS corrected,
           CASE WHEN count(*) > 0 THEN round(count(*) FILTER (l.quality = 1 AND l.toxic = 0) / count(*)::DOUBLE, 6) END AS agreement,
           CASE WHEN count(*) FILTER (l.toxic = 1) > 0 THEN round(count(*) FILTER (l.quality = 1 AND l.toxic = 1) / count(*) FILTER (l.toxic = 1)::DOUBLE, 6) END AS kept_toxic
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1""")
def q_quality_agreement(spark, sf_dir):
    j = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    clean, toxic = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)), F.count_if(F.col("toxic") == 1)
    return j.groupBy("source").agg(
        F.count("*").alias("n"), clean.alias("unchanged"), toxic.alias("corrected"), stats.ratio(clean, F.count("*")).alias("agreement"),
        stats.ratio(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)), toxic).alias("kept_toxic"),
    )


@R.query("""
    WITH b AS (SELECT least(9, floor(least(l_discount * 10, 1.0) * 10))::INTEGER AS bin, least(l_discount * 10, 1.0) AS conf,
                      (l_returnflag = 'R')::INTEGER AS hit FROM lineitem),
         g AS (SELECT bin, count(*) AS n, round(avg(hit), 6) AS acc, round(avg(conf), 6) AS conf FROM b GROUP BY 1)
    SELECT bin, n, acc, conf, round(sum(n / t * abs(acc - conf)) OVER (), 6) AS ece FROM g, (SELECT sum(n)::DOUBLE AS t FROM g)""")
def q_ece(spark, sf_dir):
    conf = F.least(F.col("l_discount") * 10, F.lit(1.0))
    rows = load(spark, sf_dir, "lineitem").select(stats.confidence_bin(conf).alias("bin"), conf.alias("conf"), (F.col("l_returnflag") == "R").cast("int").alias("hit"))
    bins = rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("acc"), F.round(F.avg("conf"), 6).alias("conf"))
    total = F.sum("n").alias("t"), F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("gap")
    one = bins.agg(*total)  # of ten bins
    return bins.join(F.broadcast(one)).select("bin", "n", "acc", "conf", F.round(F.col("gap") / F.col("t"), 6).alias("ece"))


@R.query("""
    SELECT substr(o_orderpriority, 1, 1)::INTEGER AS depth, count(*) AS n, round(avg((o_orderstatus = 'F')::INTEGER), 6) AS exact,
           round(avg((o_orderstatus IN ('F', 'P'))::INTEGER), 6) AS ancestor,
           round(avg(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END), 6) AS mean_distance FROM orders GROUP BY 1""")
def q_depth_calibration(spark, sf_dir):
    s = F.col("o_orderstatus")
    mean = lambda c: F.round(F.avg(c), 6)
    return load(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("depth")).agg(
        F.count("*").alias("n"), mean((s == "F").cast("int")).alias("exact"), mean(s.isin("F", "P").cast("int")).alias("ancestor"),
        mean(F.when(s == "F", 0).when(s == "P", 1).otherwise(2)).alias("mean_distance"),
    )


@R.query("""
    SELECT event_type, count(*) AS n, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95
    FROM events GROUP BY 1""")
def q_latency_pct(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95")
    )


@R.query("""
    SELECT event_type, quantile_disc(value::DOUBLE, 0.5) AS p50, quantile_disc(value::DOUBLE, 0.9) AS p90, quantile_disc(value::DOUBLE, 0.99) AS p99
    FROM events GROUP BY 1""")
def q_pct_disc(spark, sf_dir):
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


@R.query("""
    WITH r AS (SELECT user_id % 5 AS model, event_type = 'error' AS failed, value FROM events)
    SELECT model, count(*) AS n, round(count(*) FILTER (NOT failed) / count(*)::DOUBLE, 4) AS success_rate,
           list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.5)::BIGINT) + 1] AS p50,
           list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95 FROM r GROUP BY 1""")
def q_eval_run(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("model", F.col("user_id") % 5)
    n = F.col("n")
    ok = e.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
    # ranks by counting rows of equal values, so that no model's values meet in one task as a list
    counts = e.groupBy("model", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("model").orderBy("value")).alias("upto")
    at = counts.select("model", "value", upto).join(F.broadcast(ok), "model")
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(n - 1, F.floor(n * p)), F.col("value")))
    pct = at.groupBy("model").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))
    return ok.join(pct, "model").select("model", "n", F.round(F.col("ok") / n, 4).alias("success_rate"), "p50", "p95")


@R.query("""
    WITH g AS (SELECT l_returnflag || l_linestatus AS field, count(*)::DOUBLE AS n, (count(*) FILTER (l_quantity < 25))::DOUBLE AS k FROM lineitem GROUP BY 1)
    SELECT field, round(k / n, 6) AS rate,
           round(greatest(0.0, (k/n + 1.96*1.96/(2*n) - 1.96*sqrt((k/n*(1-k/n) + 1.96*1.96/(4*n))/n)) / (1 + 1.96*1.96/n)), 6) AS lower,
           round(least(1.0, (k/n + 1.96*1.96/(2*n) + 1.96*sqrt((k/n*(1-k/n) + 1.96*1.96/(4*n))/n)) / (1 + 1.96*1.96/n)), 6) AS upper FROM g""")
def q_wilson(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("field")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") < 25).alias("k")
    )
    bounds = stats.wilson(F.col("k"), F.col("n"))
    return g.select("field", F.round(F.col("k") / F.col("n"), 6).alias("rate"), *(F.round(c, 6).alias(k) for k, c in bounds.items()))


@R.query("""
    WITH s AS (SELECT event_type, list_sort(list(value / 100)) AS v, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, round(v[least(n - 1, floor(n * 0.15)::BIGINT) + 1], 3) AS abstain_below,
           round(greatest(v[least(n - 1, floor(n * 0.9)::BIGINT) + 1], v[least(n - 1, floor(n * 0.15)::BIGINT) + 1] + 0.05), 3) AS review_above FROM s""")
def q_threshold_quantiles(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("event_type", (F.col("value") / 100).alias("v")).agg(F.count("*").alias("c"))
    upto = e.withColumn("upto", F.sum("c").over(Window.partitionBy("event_type").orderBy("v")))
    total = upto.groupBy("event_type").agg(F.max("upto").alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("v")))
    cuts = upto.join(F.broadcast(total), "event_type").groupBy("event_type").agg(at(0.15).alias("a"), at(0.9).alias("b"))
    return cuts.select("event_type", F.round("a", 3).alias("abstain_below"), F.round(F.greatest(F.col("b"), F.col("a") + 0.05), 3).alias("review_above"))


@R.query("""
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS known,
           CASE WHEN count(*) > 0 THEN round(count(*) FILTER (o_orderstatus <> 'P') / count(*)::DOUBLE, 6) END AS known_fraction,
           sum(floor(o_totalprice) ) FILTER (o_orderstatus <> 'P')::BIGINT AS known_cost FROM orders GROUP BY 1""")
def q_known_cost(spark, sf_dir):
    known = F.col("o_orderstatus") != "P"
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(known).alias("known"), stats.ratio(F.count_if(known), F.count("*")).alias("known_fraction"),
        F.sum(F.when(known, F.floor("o_totalprice"))).alias("known_cost"),
    )


@R.query("""
    WITH p AS (SELECT l.quality = 1 AS gold, CASE WHEN d.n_chars < 300 THEN NULL ELSE d.text NOT LIKE '%!!%' END AS base,
                      CASE WHEN d.n_chars < 50 THEN NULL ELSE d.text NOT LIKE '%!!%' AND d.text NOT LIKE '% | %' END AS cand
               FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT count(*) AS n, count(*) FILTER (base IS NULL AND cand = gold) AS recovered,
           count(*) FILTER (base = gold AND cand IS DISTINCT FROM gold) AS harmed,
           count(*) FILTER (base = gold AND cand = gold) AS retained, count(*) FILTER (base IS NULL AND cand IS NULL) AS dual_abstention FROM p""")
def q_pairs_compare(spark, sf_dir):
    j = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    shout, table = F.col("text").contains("!!"), F.col("text").contains(" | ")
    p = j.select(
        (F.col("quality") == 1).alias("gold"), F.when(F.col("n_chars") >= 300, ~shout).alias("base"),
        F.when(F.col("n_chars") >= 50, ~shout & ~table).alias("cand"),
    )
    same = lambda c: F.col(c) == F.col("gold")
    return p.agg(
        F.count("*").alias("n"), F.count_if(F.col("base").isNull() & same("cand")).alias("recovered"),
        F.count_if(same("base") & ~F.col("cand").eqNullSafe(F.col("gold"))).alias("harmed"),
        F.count_if(same("base") & same("cand")).alias("retained"), F.count_if(F.col("base").isNull() & F.col("cand").isNull()).alias("dual_abstention"),
    )


@R.query("""
    WITH g AS (SELECT l_orderkey, list(DISTINCT l_partkey % 20) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
         p AS (SELECT l_orderkey, list(DISTINCT l_partkey % 20) AS s FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1),
         j AS (SELECT g.l_orderkey, len(list_intersect(g.s, p.s)) AS hit, len(g.s) AS gold, len(p.s) AS pred FROM g JOIN p ON g.l_orderkey = p.l_orderkey)
    SELECT l_orderkey, round(hit / pred::DOUBLE, 6) AS precision_, round(hit / gold::DOUBLE, 6) AS recall,
           round(CASE WHEN hit = 0 THEN 0.0 ELSE 2.0 * hit / (pred + gold) END, 6) AS f1, hit = gold AND hit = pred AS exact FROM j""")
def q_prf1(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 20).alias("p"))
    both = l.groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_linenumber") <= 4, F.col("p"))).alias("g"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("p"))).alias("q")
    ).where((F.size("g") > 0) & (F.size("q") > 0))
    hit, gold, pred = F.size(F.array_intersect("g", "q")), F.size("g"), F.size("q")
    return both.select(
        "l_orderkey", F.round(hit / pred, 6).alias("precision_"), F.round(hit / gold, 6).alias("recall"),
        F.round(F.when(hit == 0, 0.0).otherwise(2.0 * hit / (pred + gold)), 6).alias("f1"), ((hit == gold) & (hit == pred)).alias("exact"),
    )


@R.query("""
    SELECT md5(text) AS family, count(DISTINCT doc_id % 5) AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 5) > 1""")
def q_leakage(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("family")).agg(
        F.count_distinct(F.col("doc_id") % 5).alias("splits"), F.count("*").alias("n")
    ).where("splits > 1")


@R.query("SELECT json_extract_string(props, '$.k')::INTEGER AS code, count(*) AS n FROM events WHERE json_valid(props) GROUP BY 1")
def q_json_hist(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("code")).agg(F.count("*").alias("n"))


@R.query("""
    SELECT l_partkey, v AS consensus, n, members FROM (
        SELECT l_partkey, v, n, sum(n) OVER (PARTITION BY l_partkey)::BIGINT AS members,
               row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, first_seen) AS rn FROM (
            SELECT l_partkey, round(l_tax * 100)::INTEGER AS v, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY 1, 2))
    WHERE rn = 1""")
def q_consensus(spark, sf_dir):
    votes = load(spark, sf_dir, "lineitem").groupBy("l_partkey", F.round(F.col("l_tax") * 100).cast("int").alias("v")).agg(
        F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first")
    )
    best = F.max_by(F.struct("v", "n"), F.struct(F.col("n"), -F.col("first")))
    return votes.groupBy("l_partkey").agg(best.alias("b"), F.sum("n").alias("members")).select(
        "l_partkey", F.col("b.v").alias("consensus"), F.col("b.n").alias("n"), "members"
    )


@R.query("""
    SELECT route, count(*) AS users FROM (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS route
        FROM events WHERE value > 60 GROUP BY 1) GROUP BY 1""")
def q_route_key(spark, sf_dir):
    routes = load(spark, sf_dir, "events").where("value > 60").groupBy("user_id").agg(
        F.array_join(F.sort_array(F.collect_set("event_type")), "+").alias("route")
    )
    return routes.groupBy("route").agg(F.count("*").alias("users"))


@R.query("""
    WITH v AS (SELECT 'p_brand' AS field, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part),
         c AS (SELECT field, v, count(*) AS n FROM v WHERE v <> '' GROUP BY 1, 2)
    SELECT field, v, n, distinct_count, non_empty FROM (SELECT *, count(*) OVER (PARTITION BY field) AS distinct_count,
        sum(n) OVER (PARTITION BY field)::BIGINT AS non_empty, row_number() OVER (PARTITION BY field ORDER BY n DESC, v) AS rn FROM c) WHERE rn <= 20""")
def q_field_stats(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    return field_stats(p, ["p_brand", "p_type", "p_size"], 20)


@R.query(r"""
    WITH v AS (SELECT p_name AS v, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN p_brand || ' '
        WHEN 2 THEN replace(p_brand, '#', '-') ELSE p_brand END AS p_name FROM part) GROUP BY 1),
         f AS (SELECT v, n, unnest(['case', 'trim', 'separator']) AS kind, unnest([lower(v), trim(v), regexp_replace(v, '[^A-Za-z0-9]+', '', 'g')]) AS form FROM v)
    SELECT kind, form, count(*) AS spellings, sum(n)::BIGINT AS n_rows, arg_max(v, (n * 1000 - length(v), v)) AS canonical FROM f GROUP BY 1, 2 HAVING count(*) > 1""")
def q_field_audit_dups(spark, sf_dir):
    b, k = F.col("p_brand"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.upper(b)).when(k == 1, F.concat(b, F.lit(" "))).when(k == 2, F.replace(b, F.lit("#"), F.lit("-"))).otherwise(b)
    return duplicate_groups(load(spark, sf_dir, "part").select(name.alias("v")))


@R.query(r"""
    WITH v AS (SELECT doc_id, text FROM documents),
         r AS (SELECT doc_id, unnest(list_filter([CASE WHEN length(text) > 3000 THEN 'long' END, CASE WHEN regexp_matches(text, '^\s|\s$') THEN 'padded' END,
             CASE WHEN regexp_matches(text, '[#%$&*]{3}') THEN 'symbols' END, CASE WHEN regexp_matches(text, '[0-9]{8}') THEN 'digits' END,
             CASE WHEN regexp_matches(text, 'https?://') THEN 'url' END, CASE WHEN length(text) < 20 THEN 'short' END], lambda x: x IS NOT NULL)) AS reason FROM v)
    SELECT reason, count(*) AS n, min(doc_id) AS first_doc FROM r GROUP BY 1""")
def q_suspicious(spark, sf_dir):
    t = F.col("text")
    flags = {
        "long": F.length(t) > 3000, "padded": t.rlike(r"^\s|\s$"), "symbols": t.rlike("[#%$&*]{3}"), "digits": t.rlike("[0-9]{8}"),
        "url": t.rlike("https?://"), "short": F.length(t) < 20,
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(reasons).alias("reason")).groupBy("reason").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc")
    )


@R.query("""
    WITH n AS (SELECT DISTINCT p_name FROM part WHERE length(p_name) >= 4)
    SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM n a JOIN n b
    ON a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 2""")
def q_near_dup_values(spark, sf_dir):
    return near_values(load(spark, sf_dir, "part").where("length(p_name) >= 4"), "p_name", 2)


@R.query("""
    WITH s AS (SELECT user_id % 8 AS scope, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM (SELECT user_id, value / 1000 AS value FROM events) GROUP BY 1)
    SELECT scope, n, round(m, 6) AS mean, round(greatest(0.0, m - 1.96 * sd / sqrt(n)), 6) AS lower, round(least(1.0, m + 1.96 * sd / sqrt(n)), 6) AS upper FROM s""")
def q_mean_interval(spark, sf_dir):
    v = F.col("value") / 1000
    s = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("scope")).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return s.select(
        "scope", "n", F.round("m", 6).alias("mean"), F.round(F.greatest(F.lit(0.0), F.col("m") - half), 6).alias("lower"),
        F.round(F.least(F.lit(1.0), F.col("m") + half), 6).alias("upper"),
    )


@R.query("""
    WITH h AS (SELECT user_id % 2 AS side, count(*)::DOUBLE AS n, count(*) FILTER (event_type = 'error') AS err,
                      quantile_disc(value::DOUBLE, 0.95) AS p95 FROM events GROUP BY 1)
    SELECT concat_ws(',', CASE WHEN c.n < 30 THEN 'too_few' END, CASE WHEN c.err / c.n > b.err / b.n THEN 'more_errors' END,
           CASE WHEN c.p95 > 2 * b.p95 THEN 'slow' END, CASE WHEN (c.n - c.err) / c.n < 0.97 * (b.n - b.err) / b.n THEN 'accuracy' END) AS reasons
    FROM h c, h b WHERE c.side = 1 AND b.side = 0""")
def q_gate(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    n, err = F.count("*"), F.count_if(F.col("event_type") == "error")
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    side = lambda k, s: e.where(F.col("user_id") % 2 == k).agg(n.alias(f"n{s}"), err.alias(f"e{s}"), p95.alias(f"p{s}"))
    c = F.col
    ok = lambda s: (c(f"n{s}") - c(f"e{s}")) / c(f"n{s}")
    reasons = F.concat_ws(
        ",", F.when(c("nc") < 30, "too_few"), F.when(c("ec") / c("nc") > c("eb") / c("nb"), "more_errors"),
        F.when(c("pc") > 2 * c("pb"), "slow"), F.when(ok("c") < 0.97 * ok("b"), "accuracy"),
    )
    return side(1, "c").join(F.broadcast(side(0, "b"))).select(reasons.alias("reasons"))


@R.query("""
    SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '' OR length(text) < 40) AS empty_count,
           round(count(*) FILTER (text IS NULL OR trim(text) = '' OR length(text) < 40) / count(*)::DOUBLE, 6) AS empty_rate FROM documents GROUP BY 1""")
def q_empty_rate(spark, sf_dir):
    empty = F.count_if(F.col("text").isNull() | (F.trim("text") == "") | (F.length("text") < 40))
    return load(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), empty.alias("empty_count"), stats.ratio(empty, F.count("*")).alias("empty_rate")
    )


@R.query("""
    WITH c AS (SELECT l_returnflag AS scope, count(*) FILTER (l_linestatus = 'O') AS correct, count(*) FILTER (l_linestatus = 'F' AND l_tax < 0.04) AS incorrect,
                      count(*) FILTER (l_linestatus = 'F' AND l_tax >= 0.04 AND l_tax < 0.07) AS abstained, count(*) FILTER (l_linestatus = 'F' AND l_tax >= 0.07) AS failed
               FROM lineitem GROUP BY 1)
    SELECT scope, correct + incorrect + abstained + failed AS eligible, correct + incorrect + abstained AS covered,
           CASE WHEN correct + incorrect + abstained + failed > 0 THEN round(correct / (correct + incorrect + abstained + failed)::DOUBLE, 6) ELSE 0 END AS correctness,
           CASE WHEN correct + incorrect > 0 THEN round(correct / (correct + incorrect)::DOUBLE, 6) ELSE 0 END AS conditional_accuracy FROM c""")
def q_fixed_population(spark, sf_dir):
    f, tax = F.col("l_linestatus") == "F", F.col("l_tax")
    c = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scope")).agg(
        F.count_if(F.col("l_linestatus") == "O").alias("a"), F.count_if(f & (tax < 0.04)).alias("b"),
        F.count_if(f & (tax >= 0.04) & (tax < 0.07)).alias("c"), F.count_if(f & (tax >= 0.07)).alias("d"),
    )
    a, b, ab, fail = F.col("a"), F.col("b"), F.col("c"), F.col("d")
    return c.select(
        "scope", (a + b + ab + fail).alias("eligible"), (a + b + ab).alias("covered"), stats.ratio_or_zero(a, a + b + ab + fail).alias("correctness"),
        stats.ratio_or_zero(a, a + b).alias("conditional_accuracy"),
    )
