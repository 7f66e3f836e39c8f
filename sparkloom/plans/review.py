"""States of work, proposals, families, gates and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import retrieval
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


# --- states of work


_STATE = """
    lines AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1),
    w AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'skipped' WHEN c_custkey IS NULL OR c_acctbal < 0 THEN 'needs_attention' WHEN n IS NULL THEN 'waiting'
                 WHEN returned = n THEN 'needs_attention' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'running' END AS category,
                 CASE WHEN o_orderstatus = 'P' THEN NULL WHEN c_custkey IS NULL THEN 'owner_missing' WHEN c_acctbal < 0 THEN 'owner_blocked' WHEN returned = n THEN 'all_returned' END AS reason,
                 coalesce(n, 0) AS n_lines, coalesce(suppliers, 0) AS suppliers
          FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN lines ON l_orderkey = o_orderkey)"""


def _work(spark, sf_dir):
    """One row of state for each order from three sources: the order, its owner and its lines."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.countDistinct("l_suppkey").alias("suppliers")
    )
    owners = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit(True).alias("known"))
    w = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, "o_orderkey", "left").join(owners, "o_custkey", "left")
    skipped, unknown, blocked, back = F.col("o_orderstatus") == "P", F.col("known").isNull(), F.col("c_acctbal") < 0, F.col("returned") == F.col("n")
    category = (
        F.when(skipped, "skipped").when(unknown | blocked, "needs_attention").when(F.col("n").isNull(), "waiting").when(back, "needs_attention")
        .when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    )
    reason = F.when(skipped, None).when(unknown, "owner_missing").when(blocked, "owner_blocked").when(back, "all_returned")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c if c != "n" else "n_lines")
    return w.select("o_orderkey", category.alias("category"), reason.alias("reason"), zero("n"), zero("suppliers"))


@R.query(f"WITH {_STATE} SELECT * FROM w")
def q_work_state(spark, sf_dir):
    return _work(spark, sf_dir)


@R.query(f"""
    WITH {_STATE}, k AS (SELECT o_orderkey, category, reason, lpad((CASE category WHEN 'needs_attention' THEN 0 WHEN 'running' THEN 1 WHEN 'waiting' THEN 2 ELSE 3 END)::VARCHAR, 1, '0') || ':' || lpad((1000 - n_lines)::VARCHAR, 4, '0') || ':' || lpad(o_orderkey::VARCHAR, 12, '0') AS sort_key
          FROM w WHERE category <> 'skipped')
    SELECT * FROM k ORDER BY sort_key LIMIT 50""")
def q_review_queue(spark, sf_dir):
    """The first page of what is to be looked at: attention first, then many lines."""
    c = F.col("category")
    group = F.when(c == "needs_attention", 0).when(c == "running", 1).when(c == "waiting", 2).otherwise(3)
    key = F.concat_ws(":", group.cast("string"), F.lpad((1000 - F.col("n_lines")).cast("string"), 4, "0"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return _work(spark, sf_dir).where(c != "skipped").select("o_orderkey", "category", "reason", key.alias("sort_key")).orderBy("sort_key").limit(50)


@R.query(f"""
    WITH {_STATE} SELECT category, coalesce(reason, '') AS reason, count(*) AS n, sum(n_lines)::BIGINT AS n_lines, count(*) FILTER (suppliers > 3) AS wide FROM w GROUP BY 1, 2""")
def q_work_counts(spark, sf_dir):
    return _work(spark, sf_dir).groupBy("category", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("n"), F.sum("n_lines").alias("n_lines"), F.count_if(F.col("suppliers") > 3).alias("wide")
    )


@R.query("""
    WITH a AS (SELECT o_orderpriority AS kind, year(o_orderdate) AS run, count(*) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS top FROM orders GROUP BY 1, 2),
         m AS (SELECT kind, run, 'n' AS metric, n::DOUBLE AS v FROM a UNION ALL SELECT kind, run, 'total', total FROM a UNION ALL SELECT kind, run, 'top', top FROM a)
    SELECT x.kind, x.run, x.metric, round(y.v - x.v, 2) AS delta, CASE WHEN y.v IS NULL THEN 'missing' END AS reason
    FROM m x LEFT JOIN m y ON y.kind = x.kind AND y.metric = x.metric AND y.run = x.run + 1""")
def q_run_compare(spark, sf_dir):
    """Each run of a kind against the next, metric by metric; a reason where there is none."""
    a = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").alias("run")).agg(
        F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("top")
    )
    m = a.unpivot(["kind", "run"], ["n", "total", "top"], "metric", "v")
    after = m.select("kind", (F.col("run") - 1).alias("run"), "metric", F.col("v").alias("w"))
    return m.join(after, ["kind", "run", "metric"], "left").select("kind", "run", "metric", F.round(F.col("w") - F.col("v"), 2).alias("delta"), F.when(F.col("w").isNull(), "missing").alias("reason"))


# --- proposals and families


@R.query("""
    WITH p AS (SELECT l_orderkey, l_linenumber AS id, l_discount AS confidence, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'pending' ELSE 'stale' END AS status FROM lineitem),
         b AS (SELECT l_orderkey, max(struct_pack(s := CASE status WHEN 'accepted' THEN 1 ELSE 0 END, c := CASE status WHEN 'accepted' THEN 0 ELSE confidence END, i := -id)) FILTER (status <> 'stale') AS b FROM p GROUP BY 1)
    SELECT l_orderkey, coalesce(-b.i, -1) AS proposal, CASE b.s WHEN 1 THEN 'accepted' WHEN 0 THEN 'provisional' END AS source FROM b""")
def q_proposal_choice(spark, sf_dir):
    """The first accepted proposal of each key, else the surest that is pending, else none."""
    flag = F.col("l_returnflag")
    taken = (flag == "A").cast("int")
    rank = F.when(flag != "R", F.struct(taken.alias("s"), F.when(flag == "A", 0.0).otherwise(F.col("l_discount")).alias("c"), (-F.col("l_linenumber")).alias("i")))
    b = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(rank).alias("b"))
    return b.select("l_orderkey", F.coalesce(-F.col("b.i"), F.lit(-1)).alias("proposal"), F.when(F.col("b.s") == 1, "accepted").when(F.col("b.s") == 0, "provisional").alias("source"))


@R.query(r"""
    WITH t AS (SELECT p_brand, p_type, p_size, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || '.' END AS title FROM part)
    SELECT p_brand, p_type, p_size, count(*) AS candidates, CASE WHEN count(DISTINCT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')) = 1 THEN arg_min(title, p_partkey) END AS choice FROM t GROUP BY 1, 2, 3""")
def q_name_choice(spark, sf_dir):
    """The first of a group's names where all are the same but for form, else none.
    Least and greatest form tell that without a list of them."""
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(".")))
    key = ["p_brand", "p_type", "p_size"]
    t = p.select(*key, k, title.alias("title"))
    form = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "")
    return t.groupBy(*key).agg(F.count("*").alias("candidates"), F.when(F.min(form) == F.max(form), F.min_by("title", k)).alias("choice"))


@R.query("""
    WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey % 4 AS brand, l_linenumber AS sku FROM lineitem),
         n AS (SELECT l_orderkey, count(DISTINCT sku) AS members, count(DISTINCT brand) AS brands FROM m GROUP BY 1), b AS (SELECT l_orderkey, brand, count(DISTINCT sku) AS having_it FROM m GROUP BY 1, 2)
    SELECT n.l_orderkey, n.members, n.brands, CASE WHEN n.brands <= 1 THEN 'passed' ELSE 'conflict' END AS outcome, count(*) FILTER (b.having_it = n.members) AS shared FROM n JOIN b ON b.l_orderkey = n.l_orderkey GROUP BY 1, 2, 3""")
def q_brand_coherence(spark, sf_dir):
    """Whether the members of a family resolve to one brand, and how many brands all share."""
    m = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("brand"), F.col("l_linenumber").alias("sku")).distinct()
    n = m.groupBy("l_orderkey").agg(F.countDistinct("sku").alias("members"), F.countDistinct("brand").alias("brands"))
    b = m.groupBy("l_orderkey", "brand").agg(F.countDistinct("sku").alias("having_it"))
    found = b.join(n, "l_orderkey").groupBy("l_orderkey", "members", "brands").agg(F.count_if(F.col("having_it") == F.col("members")).alias("shared"))
    return found.select("l_orderkey", "members", "brands", F.when(F.col("brands") <= 1, "passed").otherwise("conflict").alias("outcome"), "shared")


@R.query(r"""
    WITH t AS (SELECT p_brand, p_type, p_partkey, p_brand || ' ' || CASE WHEN p_partkey % 50 = 7 THEN 'Big ' ELSE '' END || p_type || CASE WHEN p_size % 5 > 0 THEN ' ' || p_size || ' oz' ELSE '' END AS title FROM part),
         k AS (SELECT *, trim(regexp_replace(title, '[0-9]+ oz$', '<size>')) AS skeleton FROM t)
    SELECT p_brand, p_type, count(*) AS members, count(DISTINCT skeleton) AS skeletons, count(*) FILTER (skeleton LIKE '%<size>') AS sized, count(DISTINCT skeleton) = 1 AS consistent FROM k GROUP BY 1, 2""")
def q_family_titles(spark, sf_dir):
    """Whether the titles of a family are the same but for their size."""
    big, size = F.when(F.col("p_partkey") % 50 == 7, "Big ").otherwise(""), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" oz"))).otherwise("")
    skeleton = F.trim(F.regexp_replace(F.concat("p_brand", F.lit(" "), big, "p_type", size), "[0-9]+ oz$", "<size>"))
    k = load(spark, sf_dir, "part").groupBy("p_brand", "p_type", skeleton.alias("skeleton")).agg(F.count("*").alias("n"))
    found = k.groupBy("p_brand", "p_type").agg(
        F.sum("n").alias("members"), F.count("*").alias("skeletons"), F.coalesce(F.sum(F.when(F.col("skeleton").endswith("<size>"), F.col("n"))), F.lit(0)).alias("sized")
    )
    return found.withColumn("consistent", F.col("skeletons") == 1)


@R.query("""
    SELECT p_partkey, CASE WHEN p_name LIKE '%hot%' AND p_name NOT LIKE '%ring%' THEN 'unsuited' WHEN p_name LIKE '%red%' AND p_type IN ('LARGE', 'MEDIUM') THEN 'conflicting'
        WHEN p_type = 'SMALL' AND p_size > 40 THEN 'form' WHEN NOT regexp_matches(p_name, 'red|blue|hot|small') AND p_size < 5 THEN 'no_evidence' END AS veto FROM part""")
def q_type_veto(spark, sf_dir):
    """The first rule that rejects a candidate type on the evidence of its name."""
    n, t, s = F.col("p_name"), F.col("p_type"), F.col("p_size")
    veto = (
        F.when(n.contains("hot") & ~n.contains("ring"), "unsuited").when(n.contains("red") & t.isin("LARGE", "MEDIUM"), "conflicting")
        .when((t == "SMALL") & (s > 40), "form").when(~n.rlike("red|blue|hot|small") & (s < 5), "no_evidence")
    )
    return load(spark, sf_dir, "part").select("p_partkey", veto.alias("veto"))


@R.query("""
    WITH v AS (SELECT l_orderkey, l_linenumber, [l_returnflag, l_linestatus, 's' || l_suppkey % 3] AS axes FROM lineitem), e AS (SELECT o_orderkey, [CASE o_orderstatus WHEN 'P' THEN 'N' ELSE 'R' END, 's' || o_custkey % 3] AS want FROM orders),
         m AS (SELECT o_orderkey, count(*) FILTER (list_has_all(axes, want)) AS hits, min(l_linenumber) FILTER (list_has_all(axes, want)) AS line FROM e JOIN v ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT o_orderkey, CASE WHEN hits = 1 THEN line ELSE -1 END AS variant, CASE hits WHEN 0 THEN 'unresolved' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM m""")
def q_variant_identity(spark, sf_dir):
    """The variant that has all axes asked for, where there is just one."""
    axes = F.array("l_returnflag", "l_linestatus", F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")))
    want = F.array(F.when(F.col("o_orderstatus") == "P", "N").otherwise("R"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")))
    v = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", axes.alias("axes"))
    e = load(spark, sf_dir, "orders").select("o_orderkey", want.alias("want"))
    hit = F.size(F.array_except("want", "axes")) == 0
    m = e.join(v, "o_orderkey").groupBy("o_orderkey").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("l_linenumber"))).alias("line"))
    outcome = F.when(F.col("hits") == 0, "unresolved").when(F.col("hits") == 1, "unique").otherwise("ambiguous")
    return m.select("o_orderkey", F.when(F.col("hits") == 1, F.col("line")).otherwise(-1).alias("variant"), outcome.alias("outcome"))


@R.query("""
    SELECT p_brand, p_type, count(*) AS members, min(p_partkey) AS main, array_to_string(list(p_partkey ORDER BY p_partkey)[1:10], ',') AS siblings FROM part GROUP BY p_brand, p_type HAVING count(*) > 1""")
def q_siblings(spark, sf_dir):
    """Families of two or more with the first ten members; ranks are cut before keys meet."""
    p, key = load(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey"), ["p_brand", "p_type"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("p_partkey"))
    top = p.withColumn("rn", rank).where("rn <= 10").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("siblings"))
    n = p.groupBy(*key).agg(F.count("*").alias("members"), F.min("p_partkey").alias("main")).where("members > 1")
    return n.join(top, key).select(*key, "members", "main", "siblings")


# --- scores


@R.query("""
    WITH s AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN html LIKE '%<h1%' AND url LIKE 'https%' THEN 2 ELSE 0 END + CASE WHEN url LIKE '%ref=%' THEN 1 ELSE 0 END + CASE WHEN length(html) > 2000 THEN 1 ELSE 0 END AS points FROM pages)
    SELECT page_id, points, points >= 2 AS proven FROM s""")
def q_identity_proof(spark, sf_dir):
    u, h = F.col("url"), F.col("html")
    signals = ((F.col("page_id") % 7 == 0, 3), (h.contains("<h1") & u.startswith("https"), 2), (u.contains("ref="), 1), (F.length(h) > 2000, 1))
    points = sum((F.when(c, w).otherwise(0) for c, w in signals), F.lit(0))
    return load(spark, sf_dir, "pages").select("page_id", points.alias("points"), (points >= 2).alias("proven"))


@R.query("""
    WITH h AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, string_split(lower(p_name), ' ') AS words, ['red', 'blue', 'ring'] AS hints FROM part)
    SELECT p_partkey, (CASE WHEN ltrim((p_partkey % 100)::VARCHAR, '0') = ltrim(lpad(p_size::VARCHAR, 12, '0'), '0') AND p_partkey % 100 <> 0 THEN 1000 ELSE 0 END + 20 * len(list_intersect(hints, words))
        + CASE WHEN list_contains(hints, lower(words[1])) THEN 60 ELSE 0 END + CASE WHEN contains(lower(p_brand), p_size::VARCHAR) THEN 50 ELSE 0 END)::BIGINT AS score FROM h""")
def q_variant_score(spark, sf_dir):
    """Points of a variant: equal codes without leading zeros, hints among its words, its first word, its code in a name."""
    words, hints, size = F.split(F.lower("p_name"), " "), F.array(*map(F.lit, ("red", "blue", "ring"))), F.col("p_size").cast("string")
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    code = bare((F.col("p_partkey") % 100).cast("string"))
    score = (
        F.when((code != "") & (code == bare(F.lpad(size, 12, "0"))), 1000).otherwise(0) + 20 * F.size(F.array_intersect(hints, words))
        + F.when(F.array_contains(hints, F.get(words, F.lit(0))), 60).otherwise(0) + F.when(F.contains(F.lower("p_brand"), size), 50).otherwise(0)
    )
    return load(spark, sf_dir, "part").select("p_partkey", score.cast("long").alias("score"))


@R.query("""
    WITH r AS (SELECT l_suppkey, l_returnflag = 'R' AS gap, l_discount AS q, CASE WHEN year(l_shipdate) % 2 = 0 THEN 'base' ELSE 'hybrid' END AS run FROM lineitem),
         a AS (SELECT l_suppkey, count(*) FILTER (run = 'base' AND gap) AS bg, count(*) FILTER (run = 'hybrid' AND gap) AS hg, count(*) FILTER (run = 'base' AND NOT gap) AS ba, count(*) FILTER (run = 'hybrid' AND NOT gap) AS ha,
                      avg(q) FILTER (run = 'base' AND NOT gap) AS bq, avg(q) FILTER (run = 'hybrid' AND NOT gap) AS hq FROM r GROUP BY 1),
         s AS (SELECT *, ba / nullif(ba + bg, 0)::DOUBLE AS bs, ha / nullif(ha + hg, 0)::DOUBLE AS hs FROM a)
    SELECT l_suppkey, hg > bg AS gaps_inflated, ha < ba AS refused, coalesce(hq > bq + 1e-6 AND hs < bs - 1e-6, false) AS traded,
           hg > bg OR ha < ba OR coalesce(hq > bq + 1e-6 AND hs < bs - 1e-6, false) AS gaming FROM s""")
def q_gaming(spark, sf_dir):
    """Whether a run looks better only because it left more out: one pass, two runs side by side."""
    gap = F.col("l_returnflag") == "R"
    base = F.year("l_shipdate") % 2 == 0
    a = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        *(F.count_if(run & g).alias(name) for name, run, g in (("bg", base, gap), ("hg", ~base, gap), ("ba", base, ~gap), ("ha", ~base, ~gap))),
        F.avg(F.when(base & ~gap, F.col("l_discount"))).alias("bq"), F.avg(F.when(~base & ~gap, F.col("l_discount"))).alias("hq"),
    )
    c = F.col
    served = lambda x: stats.ratio(c(f"{x}a"), c(f"{x}a") + c(f"{x}g"))
    inflated, refused = c("hg") > c("bg"), c("ha") < c("ba")
    traded = F.coalesce((c("hq") > c("bq") + 1e-6) & (served("h") < served("b") - 1e-6), F.lit(False))
    return a.select("l_suppkey", inflated.alias("gaps_inflated"), refused.alias("refused"), traded.alias("traded"), (inflated | refused | traded).alias("gaming"))


@R.query("""
    WITH p AS (SELECT l_suppkey, l_returnflag <> 'N' AS claims, l_linenumber > 2 AS supported, l_linenumber = 5 AS contradicted, l_linestatus = 'F' AND l_tax > 0.05 AS corrected, l_discount > 0.03 AS cited FROM lineitem)
    SELECT l_suppkey, count(*) FILTER (claims) AS claims, round(count(*) FILTER (claims AND supported) / nullif(count(*) FILTER (claims), 0)::DOUBLE, 6) AS coverage, round(count(*) FILTER (claims AND contradicted) / nullif(count(*) FILTER (claims), 0)::DOUBLE, 6) AS contradiction,
           round(count(*) FILTER (corrected AND cited) / nullif(count(*) FILTER (corrected), 0)::DOUBLE, 6) AS cited FROM p GROUP BY 1""")
def q_grounding(spark, sf_dir):
    """Shares of claims with support and contradictions, and of corrections with citations; null where there are none."""
    claims, corrected = F.col("l_returnflag") != "N", (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.05)
    share = lambda part, all_: stats.ratio(F.count_if(part & all_), F.count_if(all_))
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(claims).alias("claims"), share(F.col("l_linenumber") > 2, claims).alias("coverage"), share(F.col("l_linenumber") == 5, claims).alias("contradiction"),
        share(F.col("l_discount") > 0.03, corrected).alias("cited"),
    )


@R.query("""
    WITH f AS (SELECT l_orderkey, o_orderstatus, l_returnflag <> 'N' AS available, l_linestatus <> 'O' AS applicable, l_discount > 0.01 AS correct FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT o_orderstatus, count(*) AS samples, count(*) FILTER (served) AS served, round(count(*) FILTER (served) / count(*)::DOUBLE, 6) AS rate
    FROM (SELECT l_orderkey, o_orderstatus, o_orderstatus <> 'P' AND bool_and(NOT (available AND applicable) OR correct) AS served FROM f GROUP BY 1, 2) GROUP BY 1""")
def q_served(spark, sf_dir):
    """A sample is served where every field that is available and applies is right."""
    needed = (F.col("l_returnflag") != "N") & (F.col("l_linestatus") != "O")
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(~needed | (F.col("l_discount") > 0.01)).alias("right"))
    s = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey")
    served = F.count_if((F.col("o_orderstatus") != "P") & F.col("right"))
    return s.groupBy("o_orderstatus").agg(F.count("*").alias("samples"), served.alias("served"), F.round(served / F.count("*"), 6).alias("rate"))


@R.query("""
    WITH c AS (SELECT p_brand, p_name AS want, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN string_split(p_name, ' ')[1] WHEN 2 THEN p_name || ' x' ELSE '' END AS got, string_split(p_name, ' ') AS kept FROM part)
    SELECT p_brand, count(*) AS cases, count(*) FILTER (lower(trim(got)) = lower(want) AND want <> '') AS exact, sum(len(kept))::BIGINT AS tokens, sum(len(list_filter(kept, lambda t: contains(lower(got), lower(t)))))::BIGINT AS preserved,
           round(sum(len(list_filter(kept, lambda t: contains(lower(got), lower(t))))) / sum(len(kept))::DOUBLE, 4) AS rate FROM c GROUP BY 1""")
def q_title_score(spark, sf_dir):
    k, words = F.col("p_partkey") % 4, F.split("p_name", " ")
    got = F.when(k == 0, F.upper("p_name")).when(k == 1, F.get(words, F.lit(0))).when(k == 2, F.concat("p_name", F.lit(" x"))).otherwise("")
    c = load(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("want"), got.alias("got"), words.alias("kept"))
    preserved, tokens = F.sum(F.size(F.filter("kept", lambda t: F.contains(F.lower("got"), F.lower(t))))), F.sum(F.size("kept"))
    exact = (F.lower(F.trim("got")) == F.lower("want")) & (F.col("want") != "")
    return c.groupBy("p_brand").agg(F.count("*").alias("cases"), F.count_if(exact).alias("exact"), tokens.alias("tokens"), preserved.alias("preserved"), F.round(preserved / tokens, 4).alias("rate"))


@R.query("""
    WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'list' ELSE 'text' END AS field, CASE WHEN l_tax > 0.01 THEN l_returnflag || l_linestatus END AS want, CASE WHEN l_discount > 0.02 THEN l_returnflag || CASE WHEN l_tax > 0.04 THEN lower(l_linestatus) ELSE 'x' END END AS got FROM lineitem),
         m AS (SELECT field, CASE WHEN want IS NULL THEN CASE WHEN field = 'list' THEN coalesce(len(got), 0) = 0 ELSE got IS NULL END WHEN got IS NULL THEN false
              WHEN field = 'list' THEN len(list_intersect(string_split(lower(want), ''), string_split(lower(got), ''))) / len(list_distinct(list_concat(string_split(lower(want), ''), string_split(lower(got), ''))))::DOUBLE >= 0.5
              WHEN field = 'code' THEN want = got ELSE lower(trim(want)) = lower(trim(got)) END AS hit FROM f)
    SELECT field, count(*) AS n, count(*) FILTER (hit) AS hits FROM m GROUP BY 1""")
def q_field_match(spark, sf_dir):
    """Predicted against labelled fields: a missing label wants nothing, codes match exactly, lists by half, text but for case."""
    n = F.col("l_linenumber") % 3
    field = F.when(n == 0, "code").when(n == 1, "list").otherwise("text")
    want = F.when(F.col("l_tax") > 0.01, F.concat("l_returnflag", "l_linestatus"))
    got = F.when(F.col("l_discount") > 0.02, F.concat("l_returnflag", F.when(F.col("l_tax") > 0.04, F.lower("l_linestatus")).otherwise("x")))
    f = load(spark, sf_dir, "lineitem").select(field.alias("field"), want.alias("want"), got.alias("got"))
    letters = lambda c: F.array_distinct(F.split(F.lower(c), ""))
    lists = retrieval.jaccard(letters("want"), letters("got")) >= 0.5
    hit = (
        F.when(F.col("want").isNull(), F.col("got").isNull()).when(F.col("got").isNull(), False).when(F.col("field") == "list", lists)
        .when(F.col("field") == "code", F.col("want") == F.col("got")).otherwise(F.lower(F.trim("want")) == F.lower(F.trim("got")))
    )
    return f.groupBy("field").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))


@R.query("""
    WITH r AS (SELECT l_partkey, count(*) AS candidates, count(*) FILTER (l_discount >= 0.1) AS whole FROM lineitem GROUP BY 1)
    SELECT l_partkey, CASE WHEN candidates = 1 THEN 'single_candidate_verify' WHEN whole = 1 THEN 'verified_unique_identity' END AS reason FROM r""")
def q_bypass(spark, sf_dir):
    """Why the candidates of a key need no choice: there is one, or one overlaps wholly."""
    n, whole = F.count("*"), F.count_if(F.col("l_discount") >= 0.1)
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.when(n == 1, "single_candidate_verify").when(whole == 1, "verified_unique_identity").alias("reason"))


@R.query("""
    WITH t AS (SELECT event_id, event_type, user_id, round(value * 10)::BIGINT AS tokens FROM events)
    SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 0.0 WHEN event_type IN ('error', 'signup') THEN NULL ELSE round(tokens / 1e6 * CASE event_type WHEN 'view' THEN 0.14 WHEN 'click' THEN 0.435 ELSE 2.5 END + CASE event_type WHEN 'view' THEN 0.28 WHEN 'click' THEN 0.87 ELSE 0 END * tokens * 2 / 1e6 + 1e-9, 6) END::DOUBLE AS cost,
           CASE WHEN user_id % 5 = 0 THEN 'local_zero' WHEN event_type IN ('error', 'signup') THEN 'unknown' ELSE 'published_rate' END AS basis FROM t""")
def q_call_cost(spark, sf_dir):
    """Cost of a call by the rates of its model: none if local, unknown without rates, input alone where output is free."""
    c = F.col
    rates = F.create_map(*(F.lit(x) for x in ("view", 0.14, "click", 0.435, "purchase", 2.5))), F.create_map(*(F.lit(x) for x in ("view", 0.28, "click", 0.87)))
    tokens = F.round(c("value") * 10).cast("long")
    cost = F.round(tokens / 1e6 * rates[0][c("event_type")] + F.coalesce(rates[1][c("event_type")], F.lit(0.0)) * tokens * 2 / 1e6 + 1e-9, 6)
    local = c("user_id") % 5 == 0
    basis = F.when(local, "local_zero").when(rates[0][c("event_type")].isNull(), "unknown").otherwise("published_rate")
    return load(spark, sf_dir, "events").select("event_id", F.when(local, 0.0).otherwise(cost).alias("cost"), basis.alias("basis"))


@R.query("""
    WITH r AS (SELECT l_shipmode AS config, l_suppkey % 10 AS scope, l_quantity AS ms, l_returnflag = 'R' AS gap FROM (SELECT *, l_linenumber % 3 AS l_shipmode FROM lineitem)),
         m AS (SELECT scope, config, count(*) AS samples, count(*) FILTER (NOT gap) AS measured, round(avg(ms) FILTER (NOT gap), 1) AS mean_ms FROM r GROUP BY 1, 2),
         k AS (SELECT scope, config, ms, row_number() OVER (PARTITION BY scope, config ORDER BY ms) AS rn, count(*) OVER (PARTITION BY scope, config) AS n FROM r WHERE NOT gap)
    SELECT m.scope, m.config, m.samples, m.measured, m.mean_ms, k.ms AS p95, m.mean_ms - b.mean_ms AS over_first FROM m
    LEFT JOIN k ON k.scope = m.scope AND k.config = m.config AND k.rn = least(k.n, floor(k.n * 0.95) + 1) LEFT JOIN m b ON b.scope = m.scope AND b.config = 0""")
def q_scope_cost(spark, sf_dir):
    """Measured times of each configuration by scope, and against the first. The
    95th percentile is read off counts of values, so no group is sorted as a whole."""
    r = load(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("config"), (F.col("l_suppkey") % 10).alias("scope"), F.col("l_quantity").alias("ms"), (F.col("l_returnflag") == "R").alias("gap"))
    key = ["scope", "config"]
    counts = r.groupBy(*key, "ms", "gap").agg(F.count("*").alias("n"))
    n = F.coalesce(F.sum(F.when(~F.col("gap"), F.col("n"))), F.lit(0))
    m = counts.groupBy(*key).agg(F.sum("n").alias("samples"), n.alias("measured"), F.round(F.sum(F.when(~F.col("gap"), F.col("n") * F.col("ms"))) / n, 1).alias("mean_ms"))
    run = counts.where("not gap").withColumn("below", F.sum("n").over(Window.partitionBy(*key).orderBy("ms"))).join(m.select(*key, "measured"), key)
    at = F.least(F.col("measured"), F.floor(F.col("measured") * 0.95) + 1)
    p95 = run.where(F.col("below") >= at).groupBy(*key).agg(F.min("ms").alias("p95"))
    first = m.where("config = 0").select("scope", F.col("mean_ms").alias("base"))
    return m.join(p95, key, "left").join(first, "scope", "left").select(*key, "samples", "measured", "mean_ms", "p95", (F.col("mean_ms") - F.col("base")).alias("over_first"))


@R.query(r"""
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*(/[^/?#]*)', 1) AS prefix, length(html) AS n FROM pages), k AS (SELECT prefix, n, min(page_id) AS page_id FROM p GROUP BY 1, 2),
         r AS (SELECT prefix, page_id, row_number() OVER (PARTITION BY prefix ORDER BY page_id) AS rn FROM k), c AS (SELECT count(DISTINCT prefix) AS clusters FROM k)
    SELECT prefix, page_id FROM r, c WHERE rn <= CASE WHEN clusters >= 3 THEN 1 ELSE 3 END QUALIFY row_number() OVER (ORDER BY rn, page_id) <= 10""")
def q_suite(spark, sf_dir):
    """One page of each cluster, up to three where there are few clusters, ten in
    all; of pages of one length in a cluster the first stands for the others."""
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*(/[^/?#]*)", 1).alias("prefix"), F.length("html").alias("n"))
    k = p.groupBy("prefix", "n").agg(F.min("page_id").alias("page_id"))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("page_id"))
    clusters = k.agg(F.countDistinct("prefix").alias("clusters"))  # one row
    r = k.withColumn("rn", rank).where("rn <= 3").join(F.broadcast(clusters))
    return r.where(F.col("rn") <= F.when(F.col("clusters") >= 3, 1).otherwise(3)).orderBy("rn", "page_id").limit(10).select("prefix", "page_id")
