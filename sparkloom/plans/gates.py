"""Promotion, baseline thresholds, extraction scores, domain costs, variant links and canonical values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, url
from ..operators import canonical, gates
from ..sources.tables import load
from .registry import Registry
from .scalar import _TRACKED, _VARIED, _key_sql

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


@R.query("""
    WITH l AS (SELECT *, struct_pack(d := l_shipdate, n := l_linenumber, p := l_partkey, s := l_suppkey, o := l_linestatus = 'O', x := l_tax, t := s_nationkey, b := s_acctbal) AS line,
                      l_returnflag = 'A' AS accepted FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
         r AS (SELECT l_orderkey, max(line) AS run, min(s_nationkey) FILTER (accepted) AS lo, max(s_nationkey) FILTER (accepted) AS hi,
                      min(l_tax) FILTER (accepted) AS low, max(l_tax) FILTER (accepted) AS high FROM l GROUP BY 1)
    SELECT o_orderkey, CASE WHEN run IS NULL THEN 'classification_authority_missing' WHEN run.t IS NULL THEN 'semantic_validation_unavailable' WHEN run.o THEN 'run_not_completed'
        WHEN run.b < 0 THEN 'semantic_validation_blocked' WHEN c_mktsegment IS NULL THEN 'reviewed_product_type_required'
        WHEN lo <> run.t OR hi <> run.t THEN 'stale_proposal_target' WHEN low <> run.x OR high <> run.x THEN 'stale_proposal_value' END AS refusal
    FROM orders LEFT JOIN r ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def q_promotion_gate(spark, sf_dir):
    """The first reason that an item may not be promoted, null where it may. The
    newest line of an order is its run, accepted lines are proposals that depend
    on the supplier's nation and the tax of that run. Least and greatest
    dependencies tell stale ones, so an order is one aggregate."""
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax", "l_linestatus", "l_shipdate", "l_returnflag").join(supplier, "l_suppkey", "left")
    line = F.struct(
        F.col("l_shipdate").alias("d"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        (F.col("l_linestatus") == "O").alias("o"), F.col("l_tax").alias("x"), F.col("s_nationkey").alias("t"), F.col("s_acctbal").alias("b"),
    )
    taken = lambda c: F.when(F.col("l_returnflag") == "A", F.col(c))
    run = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(line).alias("run"), F.min(taken("s_nationkey")).alias("lo"), F.max(taken("s_nationkey")).alias("hi"),
        F.min(taken("l_tax")).alias("low"), F.max(taken("l_tax")).alias("high"),
    )
    owners = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    items = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(run, "o_orderkey", "left").join(owners, "o_custkey", "left")
    c = F.col
    refusal = gates.first_refusal({
        "classification_authority_missing": c("run").isNull(), "semantic_validation_unavailable": c("run.t").isNull(), "run_not_completed": c("run.o"),
        "semantic_validation_blocked": c("run.b") < 0, "reviewed_product_type_required": c("c_mktsegment").isNull(),
        "stale_proposal_target": (c("lo") != c("run.t")) | (c("hi") != c("run.t")), "stale_proposal_value": (c("low") != c("run.x")) | (c("high") != c("run.x")),
    })
    return items.select("o_orderkey", refusal.alias("refusal"))


@R.query("""
    WITH r AS (SELECT l_suppkey AS scope, CASE l_linestatus WHEN 'F' THEN true WHEN 'O' THEN false END AS a, l_quantity / 50 AS field, (l_discount > 0.02)::INT::DOUBLE AS image, l_tax AS recall,
                      l_returnflag = 'R' AND l_discount = 0 AND l_tax = 0 AS bad FROM lineitem),
         s AS (SELECT scope, count(*) FILTER (bad AND NOT a)::DOUBLE AS b0, count(*) FILTER (bad AND a)::DOUBLE AS c0,
                      avg(field) FILTER (NOT a) AS b1, avg(field) FILTER (a) AS c1, sqrt(coalesce(var_samp(field) FILTER (NOT a) / count(field) FILTER (NOT a), 0) + coalesce(var_samp(field) FILTER (a) / count(field) FILTER (a), 0)) * 1.96 AS u1,
                      avg(image) FILTER (NOT a) AS b2, avg(image) FILTER (a) AS c2, sqrt(coalesce(var_samp(image) FILTER (NOT a) / count(image) FILTER (NOT a), 0) + coalesce(var_samp(image) FILTER (a) / count(image) FILTER (a), 0)) * 1.96 AS u2,
                      avg(recall) FILTER (NOT a) AS b3, avg(recall) FILTER (a) AS c3 FROM r GROUP BY 1),
         k AS (SELECT scope, 'identity_errors' AS name, b0 AS b, 0.0::DOUBLE AS t, c0 AS c, NULL::DOUBLE AS u, c0 = 0 AS ok FROM s
               UNION ALL SELECT scope, 'field_correctness', b1, b1, c1, u1, c1 - b1 - u1 > 1e-9 FROM s UNION ALL SELECT scope, 'image_precision', b2, b2, c2, u2, c2 - b2 - u2 > 1e-9 FROM s
               UNION ALL SELECT scope, 'image_recall', b3, b3 * 0.9, c3, NULL, c3 >= b3 * 0.9 - 1e-9 FROM s)
    SELECT scope, name, round(b, 6) AS baseline, round(t, 6) AS threshold, round(c, 6) AS actual, round(u, 6) AS margin, coalesce(ok, false) AS passed FROM k""")
def q_baseline_thresholds(spark, sf_dir):
    """Checks of finished lines of a supplier against its open ones, thresholds from the open ones."""
    c, arm = F.col, F.when(F.col("l_linestatus") == "F", True).when(F.col("l_linestatus") == "O", False)
    checks = gates.compare_arms(
        load(spark, sf_dir, "lineitem"), "l_suppkey", arm, {"field_correctness": c("l_quantity") / 50, "image_precision": (c("l_discount") > 0.02).cast("int")},
        {"image_recall": c("l_tax")}, {"identity_errors": (c("l_returnflag") == "R") & (c("l_discount") == 0) & (c("l_tax") == 0)},
    )
    six = lambda x: F.round(x, 6).alias(x)
    return checks.select("scope", "name", *map(six, ("baseline", "threshold", "actual", "margin")), "passed")


_FIELDS = r"""
    p AS (SELECT page_id, nullif(lower(trim(regexp_extract(html, '<title>([^<]*)', 1))), '') AS title, nullif(lower(trim(regexp_extract(html, '<h1[^>]*>([^<]*)', 1))), '') AS h1,
                 nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^/?#]+)', 1), '') AS path_lang, nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)', 1), '') AS lang,
                 nullif(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '') AS host, nullif(lower(regexp_extract(html, '<footer>&copy; ([^ <]+)', 1)), '') AS owner FROM pages),
    f AS (SELECT page_id, 'title' AS field, title AS e, h1 AS x FROM p UNION ALL SELECT page_id, 'lang', path_lang, lang FROM p UNION ALL SELECT page_id, 'host', host, owner FROM p),
    s AS (SELECT page_id, field, CASE WHEN e IS NULL THEN CASE WHEN x IS NULL THEN 'unavailable' ELSE 'unexpected' END WHEN x IS NULL THEN 'missing' WHEN e = x THEN 'correct' ELSE 'wrong' END AS status FROM f)"""


def _page_fields(spark, sf_dir):
    """(page_id, verdict, fields): what a page's markup says against its address and its title."""
    get = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    low = lambda c, pattern: F.nullif(F.lower(F.trim(F.regexp_extract(c, pattern, 1))), F.lit(""))
    p = load(spark, sf_dir, "pages").select(
        "page_id", low("html", "<title>([^<]*)").alias("title"), low("html", "<h1[^>]*>([^<]*)").alias("h1"),
        get("url", "^[a-zA-Z]+://[^/?#]+/([^/?#]+)").alias("path_lang"), get("html", '<html[^>]*lang="([^"]*)').alias("lang"),
        low("url", "^[a-zA-Z]+://([^/?#]+)").alias("host"), low("html", "<footer>&copy; ([^ <]+)").alias("owner"),
    )
    c = F.col
    pairs = {"title": (c("title"), c("h1")), "lang": (c("path_lang"), c("lang")), "host": (c("host"), c("owner"))}
    fields = F.array(*(F.struct(F.lit(k).alias("field"), gates.field_status(*v).alias("status")) for k, v in pairs.items()))
    return p.select("page_id", gates.identity_verdict(pairs["host"], pairs["title"], pairs["lang"]).alias("verdict"), fields.alias("fields"))


@R.query(f"""
    WITH {_FIELDS}, v AS (SELECT page_id, CASE WHEN host IS NOT NULL AND owner IS NOT NULL AND host <> owner THEN 'wrong_product'
             WHEN host IS NULL OR owner IS NULL THEN CASE WHEN title IS NULL OR h1 IS NULL THEN 'unidentified' WHEN contains(h1, title) THEN NULL WHEN contains(title, h1) THEN 'unidentified' ELSE 'wrong_product' END END AS no,
             CASE WHEN path_lang <> lang THEN 'wrong_variant' ELSE 'correct_match' END AS yes FROM p),
         g AS (SELECT page_id, count(*) FILTER (status NOT IN ('unavailable', 'unexpected')) AS available, count(*) FILTER (status = 'correct') AS correct,
                      coalesce(string_agg(field || ':' || status, ',' ORDER BY field DESC) FILTER (status NOT IN ('correct', 'unavailable')), '') AS failures FROM s GROUP BY 1)
    SELECT page_id, coalesce(no, yes) AS verdict, available, correct, CASE WHEN available = 0 THEN 0.0 ELSE round(correct / available, 4) END::DOUBLE AS score, failures FROM v JOIN g USING (page_id)""")
def q_extraction_score(spark, sf_dir):
    """A page's verdict and the share of its expected fields that were found right. Nothing is shuffled."""
    f = lambda *statuses: F.size(F.filter("fields", lambda x: x["status"].isin(*statuses))).cast("long")
    failed = F.filter("fields", lambda x: ~x["status"].isin("correct", "unavailable"))
    named = F.array_join(F.sort_array(F.transform(failed, lambda x: F.concat_ws(":", x["field"], x["status"])), False), ",")
    s = _page_fields(spark, sf_dir).select("page_id", "verdict", f("correct", "wrong", "missing").alias("available"), f("correct").alias("correct"), named.alias("failures"))
    return s.withColumn("score", F.when(F.col("available") == 0, 0.0).otherwise(F.round(F.col("correct") / F.col("available"), 4)))


@R.query(f"WITH {_FIELDS} SELECT field, status, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY field)), 6) AS share FROM s GROUP BY 1, 2")
def q_extraction_fields(spark, sf_dir):
    """How often each field was found right, wrong or not at all; the totals are of three fields."""
    s = _page_fields(spark, sf_dir).select(F.explode("fields").alias("x")).groupBy("x.field", "x.status").agg(F.count("*").alias("n"))
    total = s.groupBy("field").agg(F.sum("n").alias("total"))
    return s.join(F.broadcast(total), "field").select("field", "status", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@R.query("""
    WITH r AS (SELECT coalesce(s_nationkey, -1) AS domain, l_returnflag AS scope, l_linestatus = 'F' AS cand, l_quantity AS ms, l_linenumber AS requests, round(l_tax * 100) AS tax
               FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
         s AS (SELECT domain, scope, count(*) AS samples, round(coalesce(avg(ms) FILTER (NOT cand), 0), 1) AS base_ms, round(coalesce(avg(ms) FILTER (cand), 0), 1) AS cand_ms,
                      coalesce(sum(requests) FILTER (NOT cand), 0)::BIGINT AS base_requests, coalesce(sum(requests) FILTER (cand), 0)::BIGINT AS cand_requests,
                      coalesce(sum(tax) FILTER (NOT cand), 0) AS base_minutes, coalesce(sum(tax) FILTER (cand), 0) AS cand_minutes,
                      CASE WHEN min(tax) > 0 THEN 'measured' ELSE 'modeled' END AS basis FROM r GROUP BY 1, 2)
    SELECT domain, sum(samples)::BIGINT AS samples, count(*) AS scopes, round(sum(base_ms * samples) / sum(samples), 1) AS base_ms, round(sum(cand_ms * samples) / sum(samples), 1) AS cand_ms,
           sum(base_requests)::BIGINT AS base_requests, sum(cand_requests)::BIGINT AS cand_requests, round(sum(base_minutes), 1) AS base_minutes, round(sum(cand_minutes), 1) AS cand_minutes,
           CASE WHEN min(basis) = max(basis) THEN min(basis) ELSE 'mixed' END AS basis, round(sum(base_minutes) - sum(cand_minutes), 1) AS saved, sum(cand_minutes) <= sum(base_minutes) AS bounded FROM s GROUP BY 1""")
def q_domain_cost(spark, sf_dir):
    """Costs of the suppliers of a nation by kind of line, rolled up. Lines are
    summed by supplier before they meet the nations."""
    c = F.col
    cand, tax = c("l_linestatus") == "F", F.round(c("l_tax") * 100)
    side = lambda name, v: [F.sum(F.when(~cand, v)).alias(f"b_{name}"), F.sum(F.when(cand, v)).alias(f"c_{name}")]
    by_supplier = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", c("l_returnflag").alias("scope")).agg(
        F.count("*").alias("samples"), *side("n", F.lit(1)), *side("ms", c("l_quantity")), *side("requests", c("l_linenumber")), *side("minutes", tax), F.min(tax).alias("least")
    )
    nations = load(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("domain"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    mean = lambda a: F.round(F.coalesce(F.sum(f"{a}_ms") / F.sum(f"{a}_n"), F.lit(0.0)), 1)
    scopes = by_supplier.join(nations, "l_suppkey", "left").groupBy(F.coalesce("domain", F.lit(-1)).alias("domain"), "scope").agg(
        F.sum("samples").alias("samples"), mean("b").alias("base_ms"), mean("c").alias("cand_ms"), total("b_requests").alias("base_requests"),
        total("c_requests").alias("cand_requests"), total("b_minutes").alias("base_minutes"), total("c_minutes").alias("cand_minutes"),
        F.when(F.min("least") > 0, "measured").otherwise("modeled").alias("basis"),
    )
    return gates.roll_up_costs(scopes, "domain")


_LINK = r"""
    l AS (SELECT page_id, url AS parent, coalesce(nullif(regexp_extract(html, '<a href="([^"]*)', 1), '') || '?page=9&sku=' || regexp_extract(html, '<html[^>]*lang="([^"]*)', 1), '?variant=' || page_id::VARCHAR) AS link FROM pages),
    m AS (SELECT page_id, regexp_extract(parent, '^([^?#]*)', 1) AS body, CASE WHEN link LIKE '%#%' THEN regexp_extract(link, '#(.*)$', 1) ELSE regexp_extract(parent, '#(.*)$', 1) END AS tail,
                 list_concat(list_filter(string_split(regexp_extract(parent, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT VARIED), list_filter(string_split(regexp_extract(link, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND VARIED)) AS parts FROM l),
    w AS (SELECT page_id, body || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END || CASE WHEN tail <> '' THEN '#' || tail ELSE '' END AS url FROM m)""".replace("VARIED", _VARIED)


@R.query(f"WITH {_LINK} SELECT page_id, {_key_sql(_TRACKED)} AS deep_link FROM w")
def q_deep_links(spark, sf_dir):
    """A page's address with the variant that its first link and its language name."""
    href = F.nullif(F.regexp_extract("html", '<a href="([^"]*)', 1), F.lit(""))
    link = F.concat(href, F.lit("?page=9&sku="), F.regexp_extract("html", '<html[^>]*lang="([^"]*)', 1))
    return load(spark, sf_dir, "pages").select("page_id", url.deep_link(F.col("url"), link, F.col("page_id")).alias("deep_link"))


@R.query(r"""
    WITH a AS (SELECT p_partkey, 'brand' AS field, '  ' || upper(p_brand) || ' ' AS raw FROM part UNION ALL SELECT p_partkey, 'weight', p_size || ' oz' FROM part
               UNION ALL SELECT p_partkey, 'weight', p_type FROM part UNION ALL SELECT p_partkey, 'packCount', lpad(p_size::VARCHAR, 4, '0') FROM part UNION ALL SELECT p_partkey, 'packCount', p_name FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part)
    SELECT p_partkey, field, raw, CASE WHEN field = 'brand' THEN lower(trim(raw)) WHEN raw LIKE '% oz' AND field = 'weight' THEN printf('%.2f', round(p * 0.0625, 2)) WHEN field = 'packCount' AND p IS NOT NULL THEN p::BIGINT::VARCHAR ELSE raw END AS value,
           CASE WHEN field = 'name' THEN 'unchanged' WHEN field <> 'brand' AND p IS NULL THEN 'failed' ELSE 'normalized' END AS status
    FROM (SELECT *, TRY_CAST(regexp_extract(raw, '^([0-9]+)( oz)?$', 1) AS DOUBLE) AS p FROM a)""")
def q_identity_forms(spark, sf_dir):
    """Each attribute of a part in the form that its field is compared in."""
    a = F.array(*(F.struct(F.lit(f).alias("field"), raw.alias("raw")) for f, raw in (
        ("brand", F.concat(F.lit("  "), F.upper("p_brand"), F.lit(" "))), ("weight", F.concat(F.col("p_size").cast("string"), F.lit(" oz"))), ("weight", F.col("p_type")),
        ("packCount", F.lpad(F.col("p_size").cast("string"), 4, "0")), ("packCount", F.col("p_name")), ("name", F.col("p_name")),
    )))
    x = load(spark, sf_dir, "part").select("p_partkey", F.explode(a).alias("x")).select("p_partkey", "x.*")
    return x.select("*", identity.for_comparison(F.col("field"), F.col("raw")).alias("k")).select("p_partkey", "field", "raw", "k.*")


@R.query(r"""
    WITH v AS (SELECT doc_id, nullif(regexp_replace(nfc_normalize(text), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '') AS v FROM documents)
    SELECT doc_id, length(v) AS n_chars, md5(v) AS digest FROM v""")
def q_canonical_texts(spark, sf_dir):
    """Texts as canonical assertions: composed and trimmed, null where blank."""
    v = canonical.canonical_values(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return v.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))
