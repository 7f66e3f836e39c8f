"""Queries against their SQL on inputs that the given tables do not hold."""

import random

import duckdb
import pytest
from test_oracles import rows

import __spark_entry__ as entry
from sparkloom.operators import hamming, setjoin


def both(spark, at, name, table, df):
    """Rows of a query and of its SQL where ``table`` is ``df``."""
    df.coalesce(1).write.parquet(f"{at}/{table}.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    return rows(entry.queries()[name](spark, str(at)).toPandas()), rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entities_keep_other_ampersands(spark, tmp_path):
    html = ["a & b &quo</title>", "&eacute; &amp; &copy", "&#101; &#8364; &#38;#101; &#x41; &#;", "\x01e\x1f&\x08", "&&amp;&middot;;", "", "é&\n\te"]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    ours, theirs = both(spark, tmp_path, "q_entities", "pages", df)
    assert len(ours) == len(html) and ours == theirs


def test_wide_radius_lists_no_key_by_thousands_of_values(spark, monkeypatch):
    rng, keys = random.Random(3), []
    for _ in range(40):
        base = [rng.choice("01") for _ in range(56)]
        for k in rng.choices(range(16), k=3):
            keys.append("".join(base))
            for i in rng.sample(range(56), k):
                base[i] = "10"[int(base[i])]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(keys)] + [(None, "1" * 56), (400, "0" * 55)], "id long, bits string").repartition(3)
    first = {b: k for k, b in reversed(list(enumerate(keys)))}
    want = [(a, b, d) for x, a in first.items() for y, b in first.items() if a < b and (d := sum(p != q for p, q in zip(x, y, strict=True))) <= 14]
    monkeypatch.setattr(hamming, "PAIRS", 64, raising=False)
    monkeypatch.setattr(hamming, "FOUND", 4, raising=False)
    got = hamming.near_keys(df, "id", "bits", 14)
    assert sorted((r["a"], r["b"], r["distance"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # else 2,788 rows a key


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_similar_sets_in_parts(spark, monkeypatch, least):
    monkeypatch.setattr(setjoin, "PART", 4)
    rng = random.Random(7)
    sets = [rng.choices("abcdefghijkl", [1 / (k + 1) for k in range(12)], k=rng.randint(0, 7)) for _ in range(120)]
    rows_ = [(k, s) for k, s in enumerate(sets + 40 * [["a", "b", "x"]] + 9 * [["y"]])] + [(None, ["a"]), (500, None), (3, ["z"])]
    want, whole = {}, {}
    for k, s in rows_:
        if k is not None:
            whole[k] = whole.get(k, set()) | set(s or ())
    for a, s in whole.items():
        for b, t in whole.items():
            if a < b and s and t and (sim := len(s & t) / len(s | t)) >= least:
                want[a, b] = sim
    got = setjoin.similar_sets(spark.createDataFrame(rows_, "id long, s array<string>").repartition(3), "id", "s", least).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["sim"] for r in got} == want


def test_titles_of_one_page_are_one_set(spark, tmp_path):
    titles = [(1, "Red Wool Socks"), (1, "blue cotton"), (2, "red wool socks blue"), (3, "red cotton wool socks BLUE"), (4, ""), (5, None), (None, "red wool"), *((k, "one two") for k in range(10, 20))]
    titles = [(k, "the one " * 3) for k in range(30, 34)] + [(k, t and f"{t} two") for k, t in titles]
    df = spark.createDataFrame([(k, t and f"<title>{t}</title>") for k, t in titles], "page_id long, html string")
    ours, theirs = both(spark, tmp_path, "q_jaccard_pairs", "pages", df)
    assert ours and ours == theirs
