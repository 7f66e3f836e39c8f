"""Identifier, text and URL functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, text, url
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracles


@R.query("""
    WITH g AS (SELECT p_partkey, lpad((p_partkey * 7919 % 100000000000)::VARCHAR, CASE p_partkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 13 ELSE 11 END, '0') AS raw FROM part),
         c AS (SELECT p_partkey, CASE WHEN length(raw) IN (8, 12, 13, 14) THEN raw END AS code FROM g)
    SELECT p_partkey, code, lpad(code, 14, '0') AS gtin14,
           (10 - list_sum(list_transform(generate_series(1, 13), lambda k: substr(reverse(lpad(code, 14, '0')), k::INTEGER + 1, 1)::INTEGER * CASE WHEN k % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10
             = substr(lpad(code, 14, '0'), 14, 1)::INTEGER AS valid FROM c""")
def q_gtin(spark, sf_dir):
    k = F.col("p_partkey")
    width = F.when(k % 3 == 0, 12).when(k % 3 == 1, 13).otherwise(11)
    code = identity.gtin(F.lpad((k * 7919 % 100000000000).cast("string"), width, F.lit("0")))
    return load(spark, sf_dir, "part").select("p_partkey", code.alias("code")).select(
        "p_partkey", "code", identity.gtin14(F.col("code")).alias("gtin14"), identity.gtin_valid(F.col("code")).alias("valid")
    )


@R.query(r"""
    WITH w AS (SELECT p_partkey, p_size::VARCHAR || CASE p_partkey % 5 WHEN 0 THEN ' lb' WHEN 1 THEN 'oz' WHEN 2 THEN ' kg' WHEN 3 THEN ' stone' ELSE '' END AS raw FROM part),
         m AS (SELECT *, regexp_extract(raw, '^([0-9]+) ?(lb|oz|kg|g)?$', 1) AS n, regexp_extract(raw, '^([0-9]+) ?(lb|oz|kg|g)?$', 2) AS u FROM w)
    SELECT p_partkey, CASE WHEN n = '' THEN NULL ELSE round(n::DOUBLE * CASE u WHEN 'oz' THEN 0.0625 WHEN 'kg' THEN 2.2046226218 ELSE 1.0 END, 2) END AS pounds FROM m""")
def q_weight(spark, sf_dir):
    k = F.col("p_partkey") % 5
    unit = F.when(k == 0, " lb").when(k == 1, "oz").when(k == 2, " kg").when(k == 3, " stone").otherwise("")
    raw = F.concat(F.col("p_size").cast("string"), unit)
    return load(spark, sf_dir, "part").select("p_partkey", identity.pounds(raw).alias("pounds"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), ':(80|443)$', '')"
_PATH = r"regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"


_NAME = "lower(regexp_extract(x, '^([^=]*)', 1))"
_TRACKED = f"({_NAME} IN ('gclid', 'fbclid', 'msclkid', 'gbraid', 'wbraid', 'dclid') OR starts_with({_NAME}, 'utm_'))"
_VARIED = f"({_NAME} IN ('variant', 'variation_id', 'sku') OR starts_with({_NAME}, 'attribute_') OR starts_with({_NAME}, 'option'))"


def _key_sql(drop):
    """The address key in SQL, without the parameters ``x`` for which ``drop`` holds."""
    kept = rf"list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT {drop})"
    q = rf"array_to_string(list_transform(list_sort(list_transform({kept}, lambda x: {{'k': regexp_extract(x, '^([^=]*)', 1), 'x': x}})), lambda p: p.x), '&')"
    scheme, at = "lower(regexp_extract(url, '^([a-zA-Z]+)://', 1))", "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1))"
    place, tail = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)", "regexp_extract(url, '#(.*)$', 1)"
    return rf"""CASE WHEN {scheme} IN ('http', 'https') THEN {scheme} || '://'
        || CASE WHEN {scheme} = 'http' THEN regexp_replace({at}, ':80$', '') ELSE regexp_replace({at}, ':443$', '') END
        || CASE WHEN {place} = '' THEN '/' ELSE {place} END || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END
        || CASE WHEN {tail} <> '' THEN '#' || {tail} ELSE '' END ELSE url END"""


@R.query(f"SELECT page_id, {_key_sql(_TRACKED)} AS identity_key, {_key_sql(f'({_TRACKED} OR {_VARIED})')} AS parent_key FROM pages")
def q_url_identity(spark, sf_dir):
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", url.identity_key(u).alias("identity_key"), url.parent_key(u).alias("parent_key"))


@R.query(rf"""
    SELECT page_id, regexp_replace(regexp_extract({_PATH}, '([^/]*)$', 1), '\.[a-z]{{2,5}}$', '') AS slug,
           regexp_extract({_PATH}, '^/([^/]+)', 1) AS prefix FROM pages""")
def q_slug(spark, sf_dir):
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", url.slug(u).alias("slug"), url.prefix(u).alias("prefix"))


@R.query(f"""
    WITH h AS (SELECT page_id, string_split({_HOST}, '.') AS l FROM pages),
         n AS (SELECT page_id, l, CASE WHEN len(l) > 2 AND l[len(l) - 1] IN ('co', 'com', 'org', 'net', 'ac') THEN 3 ELSE 2 END AS n FROM h)
    SELECT array_to_string(l[greatest(1, len(l) - n + 1):], '.') AS domain, count(*) AS pages FROM n GROUP BY 1""")
def q_domain(spark, sf_dir):
    return load(spark, sf_dir, "pages").groupBy(url.registrable_domain(url.host(F.col("url"))).alias("domain")).agg(F.count("*").alias("pages"))


@R.query("""
    WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN
        ('the', 'and', 'for', 'with', 'from', 'this', 'that', 'was', 'are')) AS w FROM documents)
    SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_distinct(w))::INTEGER AS n_distinct FROM t""")
def q_tokens(spark, sf_dir):
    w = text.tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select(
        "doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct")
    )


@R.query(r"""
    SELECT conv_id, turn, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 1)))::INTEGER AS n_words FROM conversations""")
def q_letter_tokens(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.letter_tokens(F.col("text"))).alias("n_words"))


@R.query(r"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(password|token|secret|api_?key)(["'']? *[:=] *["'']?)[A-Za-z0-9+/_.=-]{6,}', '\1\2***', 'gi'),
        'AKIA[A-Z0-9]{16}', 'AKIA***', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '***@***', 'g')) AS redacted_md5 FROM documents""")
def q_redact(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


@R.query(r"""
    WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'New ' WHEN 1 THEN ' ' ELSE '' END || p_name || CASE p_partkey % 3 WHEN 0 THEN '!!' WHEN 1 THEN ' ,' ELSE '' END
            || ' ' || p_size::VARCHAR || ' oz' || CASE p_partkey % 4 WHEN 0 THEN ' -' ELSE '' END AS a FROM part),
         r1 AS (SELECT *, trim(regexp_replace(a, ' +', ' ', 'g')) AS b FROM t), r2 AS (SELECT *, regexp_replace(b, '!+', '', 'g') AS c FROM r1),
         r3 AS (SELECT *, regexp_replace(c, '([0-9]) (oz|lb)\b', '\1\2', 'g') AS d FROM r2), r4 AS (SELECT *, regexp_replace(d, '[,;-]+$', '', 'g') AS e FROM r3),
         r5 AS (SELECT *, regexp_replace(e, '^(new|sale) ', '', 'gi') AS f FROM r4)
    SELECT p_partkey, f AS title, concat_ws(',', CASE WHEN b <> a THEN 'R1' END, CASE WHEN c <> b THEN 'R2' END, CASE WHEN d <> c THEN 'R3' END,
           CASE WHEN e <> d THEN 'R4' END, CASE WHEN f <> e THEN 'R5' END) AS rules FROM r5""")
def q_title_lint(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.concat(
        F.when(k % 5 == 0, "New ").when(k % 5 == 1, " ").otherwise(""), "p_name", F.when(k % 3 == 0, "!!").when(k % 3 == 1, " ,").otherwise(""),
        F.lit(" "), F.col("p_size").cast("string"), F.lit(" oz"), F.when(k % 4 == 0, " -").otherwise(""),
    )
    return load(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in text.title_lint(raw).items()))


@R.query(r"SELECT p_partkey, sha256(concat_ws('|', coalesce(p_name, '\N'), coalesce(p_brand, '\N'), coalesce(p_size::VARCHAR, '\N'))) AS h FROM part")
def q_hash(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.canonical_hash(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("h"))


@R.query("""
    SELECT o_orderkey, sha256('observation:' || o_custkey::VARCHAR || ':' || sha256(o_orderstatus || o_orderpriority)) AS observation_id FROM orders""")
def q_observation_id(spark, sf_dir):
    payload = F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.sha2(F.concat(F.lit("observation:"), F.col("o_custkey").cast("string"), F.lit(":"), payload), 256).alias("observation_id")
    )


@R.query("""
    WITH f AS (SELECT s_suppkey, list_reduce(list_transform(string_split(s_name || ':7', ''), lambda c: ascii(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM supplier)
    SELECT s_suppkey, CASE WHEN h % 100 < 20 THEN 'holdout' WHEN h % 100 < 40 THEN 'test' ELSE 'train' END AS split FROM f""")
def q_family_split(spark, sf_dir):
    score = identity.fnv1a(F.concat("s_name", F.lit(":7"))) % 100
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.when(score < 20, "holdout").when(score < 40, "test").otherwise("train").alias("split"))


@R.query(r"""
    SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '::' || trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name),
             '\b[0-9]+(\.[0-9]+)? ?(oz|lbs?|kg|g|ml|l)\b', ' ', 'g'), '[ ,-]*\b(pack of )?[0-9]+( ?(ct|pk|count))?$', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS family,
           count(*) AS n, min(p_partkey) AS main FROM part GROUP BY 1""")
def q_family_group(spark, sf_dir):
    key = F.concat_ws("::", identity.compact_key(F.col("p_brand")), identity.name_stem(F.col("p_name")))
    return load(spark, sf_dir, "part").groupBy(key.alias("family")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("main"))


@R.query(r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS h1,
           len(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1))::INTEGER AS n_links,
           trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))[:40] AS lead FROM pages""")
def q_html_extract(spark, sf_dir):
    h = F.col("html")
    plain = F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " "))
    return load(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)", 1).alias("title"), F.regexp_extract(h, "<h1[^>]*>([^<]*)", 1).alias("h1"),
        F.size(F.regexp_extract_all(h, F.lit('<a[^>]+href="([^"]*)"'), F.lit(1))).alias("n_links"), F.substring(plain, 1, 40).alias("lead"),
    )


@R.query(r"""
    SELECT page_id, concat_ws(',', CASE WHEN url NOT LIKE 'https://%' THEN 'scheme' END, CASE WHEN regexp_matches(url, '://[0-9.]+[/:]') THEN 'ip' END,
           CASE WHEN regexp_matches(url, '://[^/]*:[0-9]+') THEN 'port' END, CASE WHEN url LIKE '%#%' THEN 'fragment' END,
           CASE WHEN regexp_matches(url, '[?&](utm_source|ref)=') THEN 'tracking' END) AS issues FROM pages""")
def q_url_policy(spark, sf_dir):
    u = F.col("url")
    checks = {
        "scheme": ~u.startswith("https://"), "ip": u.rlike("://[0-9.]+[/:]"), "port": u.rlike("://[^/]*:[0-9]+"),
        "fragment": u.contains("#"), "tracking": u.rlike("[?&](utm_source|ref)="),
    }
    return load(spark, sf_dir, "pages").select("page_id", F.concat_ws(",", *(F.when(c, k) for k, c in checks.items())).alias("issues"))


@R.query(r"""
    WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(text, 'License|rights reserved') THEN 'license' WHEN regexp_matches(text, '!!') THEN 'shout'
        WHEN text LIKE '% | %' THEN 'table' WHEN regexp_matches(text, '[#%$&*]{3}') THEN 'symbols' END AS label FROM documents)
    SELECT label, count(*) AS n FROM t GROUP BY 1""")
def q_weak_labels(spark, sf_dir):
    t = F.col("text")
    label = (
        F.when(t.rlike("License|rights reserved"), "license").when(t.contains("!!"), "shout").when(t.contains(" | "), "table")
        .when(t.rlike("[#%$&*]{3}"), "symbols")
    )
    return load(spark, sf_dir, "documents").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@R.query(r"""
    WITH c AS (SELECT page_id, url, html, CASE WHEN html IS NULL OR html = '' THEN 'invalid' WHEN regexp_extract(html, '<title>([^<]*)', 1) = '' THEN 'missing_title'
            WHEN url NOT LIKE 'http%' THEN 'invalid_url' WHEN url LIKE 'http://m.%' THEN 'blocked' WHEN NOT regexp_matches(url, '[0-9]') THEN 'non_product' END AS code FROM pages),
         r AS (SELECT *, row_number() OVER (PARTITION BY code IS NULL, regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS rn FROM c)
    SELECT coalesce(code, CASE WHEN rn > 1 THEN 'duplicate_locator' ELSE 'accepted' END) AS outcome, count(*) AS n, min(page_id) AS first_page FROM r GROUP BY 1""")
def q_bronze_cascade(spark, sf_dir):
    h, u = F.col("html"), F.col("url")
    code = (
        F.when(h.isNull() | (h == ""), "invalid").when(F.regexp_extract(h, "<title>([^<]*)", 1) == "", "missing_title")
        .when(~u.startswith("http"), "invalid_url").when(u.startswith("http://m."), "blocked").when(~u.rlike("[0-9]"), "non_product")
    )
    rows = load(spark, sf_dir, "pages").select("page_id", code.alias("code"), F.regexp_replace(u, "[?#].*$", "").alias("locator"))
    first = rows.where("code IS NULL").groupBy("locator").agg(F.min("page_id").alias("first"))
    later = F.when(F.col("page_id") > F.col("first"), "duplicate_locator").otherwise("accepted")
    return rows.join(first, "locator", "left").groupBy(F.coalesce("code", later).alias("outcome")).agg(
        F.count("*").alias("n"), F.min("page_id").alias("first_page")
    )


@R.query("""
    WITH f AS (SELECT doc_id, CASE WHEN lang = 'en' THEN true WHEN lang IN ('de', 'fr') THEN false END AS a, CASE WHEN n_chars > 2000 THEN true WHEN n_chars < 500 THEN false END AS b FROM documents)
    SELECT CASE WHEN a IS NULL THEN 'unknown' WHEN NOT a THEN 'not_applicable' WHEN b IS NULL THEN 'unknown' WHEN NOT b THEN 'not_applicable' ELSE 'applicable' END AS verdict,
           count(*) AS n FROM f GROUP BY 1""")
def q_applicability(spark, sf_dir):
    """Conditions in order: the first that is unknown or false decides."""
    lang, n = F.col("lang"), F.col("n_chars")
    conditions = (F.when(lang == "en", True).when(lang.isin("de", "fr"), False), F.when(n > 2000, True).when(n < 500, False))
    verdict = F.lit("applicable")
    for c in reversed(conditions):
        verdict = F.when(c.isNull(), "unknown").when(~c, "not_applicable").otherwise(verdict)
    return load(spark, sf_dir, "documents").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@R.query("""
    WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, ts FROM events)
    SELECT event_id, ms, date_trunc('day', ts) + INTERVAL 1 DAY + INTERVAL 3 HOUR AS next_nightly FROM t""")
def q_next_run(spark, sf_dir):
    next_day = F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL '1 03' DAY TO HOUR")
    return load(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), next_day.alias("next_nightly"))
