"""Gates, field scores, costs, variant links and canonical values on small cases."""

import unicodedata

from pyspark.sql import functions as F

from sparkloom.functions import identity, url
from sparkloom.operators import canonical, gates


def test_first_refusal_keeps_the_order_and_takes_null_as_none(spark):
    rows = spark.createDataFrame([(True, True), (False, True), (None, False), (None, None)], "a boolean, b boolean")
    got = [r[0] for r in rows.select(gates.first_refusal({"one": F.col("a"), "two": F.col("b")})).collect()]
    assert got == ["one", "two", None, None]


def compared(spark, rows):
    t = spark.createDataFrame(rows, "scope string, arm boolean, v double, bad boolean")
    found = gates.compare_arms(t, "scope", F.col("arm"), {"gain": F.col("v")}, {"floor": F.col("v")}, {"errors": F.col("bad")}).collect()
    return {(r["scope"], r["name"]): r for r in found}


def test_a_gain_must_exceed_both_margins(spark):
    rows = [("clear", False, v, False) for v in (0.1, 0.2, 0.1, 0.2)] + [("clear", True, v, False) for v in (0.8, 0.9, 0.8, 0.9)]
    rows += [("noisy", False, v, False) for v in (0.0, 1.0)] + [("noisy", True, v, False) for v in (0.2, 1.0)]
    rows += [("equal", a, 0.0, False) for a in (False, True)] + [("errs", a, 0.5, a) for a in (False, True)]
    rows += [("one", True, 0.5, False), ("null", None, 0.5, True), ("none", False, None, False), ("none", True, None, None)]
    got = compared(spark, rows)
    assert {k for k, r in got.items() if r["passed"]} == {
        ("clear", "gain"), ("clear", "floor"), ("clear", "errors"), ("noisy", "floor"), ("noisy", "errors"), ("equal", "floor"), ("equal", "errors"),
        ("errs", "floor"), ("one", "errors"), ("none", "errors"),
    }
    assert ("null", "gain") not in got
    sd = (0.01 / 3) ** 0.5  # of 0.1, 0.2, 0.1, 0.2
    assert abs(got["clear", "gain"]["margin"] - 1.96 * (2 * sd * sd / 4) ** 0.5) < 1e-12
    assert abs(got["noisy", "floor"]["threshold"] - 0.45) < 1e-12
    assert compared(spark, []) == {}


def test_field_status_and_verdict(spark):
    cases = [
        (("a", "a"), (None, None), ("en", "en"), "correct_match"), (("a", "b"), ("t", "t"), (None, None), "wrong_product"), (("a", "a"), ("t", "u"), ("en", "de"), "wrong_variant"),
        ((None, "a"), ("red ring", "red ring big"), (None, "en"), "correct_match"), ((None, None), ("red ring", "red"), (None, None), "unidentified"),
        (("a", None), ("red", "blue"), ("en", "en"), "wrong_product"), ((None, None), (None, "x"), ("en", "de"), "unidentified"),
    ]
    t = spark.createDataFrame([(*c, *n, *v) for c, n, v, _ in cases], "c string, d string, t string, u string, v string, w string")
    pair = lambda a, b: (F.col(a), F.col(b))
    assert [r[0] for r in t.select(gates.identity_verdict(pair("c", "d"), pair("t", "u"), pair("v", "w"))).collect()] == [x[3] for x in cases]
    t = spark.createDataFrame([(None, None), (None, "x"), ("x", None), ("x", "x"), ("x", "y"), ("", "")], "e string, x string")
    assert [r[0] for r in t.select(gates.field_status(F.col("e"), F.col("x"))).collect()] == ["unavailable", "unexpected", "missing", "correct", "wrong", "correct"]


def test_costs_roll_up_by_samples_and_mix_bases(spark):
    cols = "d string, samples long, base_ms double, cand_ms double, base_requests long, cand_requests long, base_minutes double, cand_minutes double, basis string"
    rows = [("a", 1, 10.0, 4.0, 3, 1, 5.0, 2.04, "measured"), ("a", 3, 20.0, 8.0, 9, 3, 6.0, 3.0, "modeled"), ("b", 0, None, None, 0, 0, None, None, "modeled")]
    got = {r["d"]: r.asDict() for r in gates.roll_up_costs(spark.createDataFrame(rows, cols), "d").collect()}
    a, b = got["a"], got["b"]
    assert (a["base_ms"], a["cand_ms"], a["base_requests"], a["cand_minutes"], a["saved"], a["basis"], a["bounded"]) == (17.5, 7.0, 12, 5.0, 6.0, "mixed", True)
    assert (b["base_ms"], b["base_minutes"], b["basis"], b["scopes"]) == (0.0, 0.0, "modeled", 1)


def test_deep_links(spark):
    cases = [
        ("https://A.example/p?variant=1&color=red&utm_source=x#top", "/p?variant=2&size=9", None, "https://a.example/p?color=red&variant=2#top"),
        ("https://a.example/p", None, 7, "https://a.example/p?variant=7"), ("https://a.example/p?x=1", None, None, "https://a.example/p?x=1"),
        ("https://a.example/p?option1=s", "https://a.example/q#blue", 7, "https://a.example/p#blue"), (None, "/q", 1, None), ("https://a.example/p?sku=1", "", 7, "https://a.example/p"),
    ]
    t = spark.createDataFrame([c[:3] for c in cases], "parent string, link string, platform long")
    assert [r[0] for r in t.select(url.deep_link(F.col("parent"), F.col("link"), F.col("platform"))).collect()] == [c[3] for c in cases]


def test_forms_for_comparison(spark):
    cases = [
        ("weight", "8 oz", "0.50", "normalized"), ("weight", "heavy", "heavy", "failed"), ("brand", "  Two  Words ", "two words", "normalized"), ("brand", "  ", "  ", "failed"),
        ("packCount", "007", "7", "normalized"), ("packCount", "-3", "-3", "failed"), ("color", " Red ", " Red ", "unchanged"), (None, "x", "x", "unchanged"), ("weight", None, None, "failed"),
    ]
    t = spark.createDataFrame([c[:2] for c in cases], "field string, raw string")
    got = [tuple(r[0]) for r in t.select(identity.for_comparison(F.col("field"), F.col("raw"))).collect()]
    assert got == [c[2:] for c in cases]


def test_canonical_values_compose_and_trim(spark):
    texts = [None, "", " \n\t", " plain ", "café", " é\n", "한", "̈́x", "😀 ok", "ạ̇", "ạ̇", "é" * 5000 + "́"]
    t = spark.createDataFrame([(k, s, "x") for k, s in enumerate(texts * 2)], "id long, v string, _composed string")
    got = {r["id"]: r["v"] for r in canonical.canonical_values(t, "v").collect()}
    want = [s if s is None else (unicodedata.normalize("NFC", s).strip(" \t\r\n") or None) for s in texts]
    assert [got[k] for k in range(2 * len(texts))] == want * 2
    assert canonical.canonical_values(t.limit(0), "v").collect() == []
    plan = canonical.canonical_values(t, "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
