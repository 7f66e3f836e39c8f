"""Names, sizes and codes on small hand-written values, and runs shared with probes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import naming
from sparkloom.operators import retrieval


def values(spark, f, *rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    return [r[0] for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


def test_ounces(spark):
    assert values(spark, naming.ounces, "16 oz", "1 lb", "1,000 g", "0 oz", "12", "", None) == [16.0, 16.0, 35.274, None, None, None, None]


def test_net_content(spark):
    got = values(spark, naming.net_content, "12 Ounces", "2kg", "x 2 kg", "3", None)
    assert [tuple(g) if g else None for g in got] == [(12.0, "oz"), (2.0, "kg"), None, None, None]


def test_brand_and_words(spark):
    assert values(spark, naming.group_brand, "Acme® Inc.", "Coco", None) == ["acme", "coco", ""]
    assert values(spark, naming.expand, "chkn trky chknx", None) == ["chicken turkey chknx", None]


def test_split_sizes_is_idempotent(spark):
    once = values(spark, naming.split_sizes, "VNSNLG", "BEEFMINI", "ClassicLg", "LGHARVEST", "SMOOTH", "5 SM5CT", None)
    assert once == ["VNSN LG", "BEEF MINI", "ClassicLg", "LG HARVEST", "SMOOTH", "5 SM5CT", None]
    assert values(spark, naming.split_sizes, *once) == once


@pytest.mark.parametrize(
    ("name", "brand", "parted", "fronted"),
    [
        ("GLOVES LGHARVEST LANE", "Harvest Lane", "GLOVES LG HARVEST LANE", "GLOVES LGHARVEST LANE"),
        ("GLOVES LG HARVEST LANE", "Harvest Lane", "GLOVES LG HARVEST LANE", "Harvest Lane GLOVES LG"),
        ("Harvest Lane gloves", "Harvest Lane", "Harvest Lane gloves", "Harvest Lane gloves"),
        ("gloves", "", "gloves", "gloves"),
        ("gloves", None, "gloves", "gloves"),
    ],
)
def test_brand_moves(spark, name, brand, parted, fronted):
    df = spark.createDataFrame([(name, brand)], "n string, b string")
    assert tuple(df.select(naming.split_before_brand(F.col("n"), F.col("b")), naming.brand_first(F.col("n"), F.col("b"))).first()) == (parted, fronted)


def test_clean_and_files(spark):
    assert values(spark, naming.clean, "- Soap |", "Soap 012345678905", "|", "", None) == ["Soap", "Soap", "|", "", None]
    assert values(spark, naming.file_name, "a.b-1_c", "a b/c%", "", None) == ["a.b-1_c", "a%20b%2Fc%25", "", None]


def test_wall_clock_in_gap_and_overlap(spark):
    walls = [datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 0), datetime(2024, 11, 3, 1, 30), datetime(2024, 7, 1, 9, 15)]
    df = spark.createDataFrame([(w,) for w in walls], "w timestamp")
    got = [r[0] for r in df.select(naming.wall_to_utc(F.col("w"), "America/New_York")).collect()]
    assert got == [datetime(2024, 3, 10, 7, 0), datetime(2024, 3, 10, 7, 0), datetime(2024, 11, 3, 5, 30), datetime(2024, 7, 1, 13, 15)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_shared_runs(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "BROADCAST_RUNS", limit)
    texts = spark.createDataFrame([(1, list("abcab")), (2, list("abcabc")), (3, list("ab")), (4, None), (5, [])], "t int, w array<string>")
    probes = spark.createDataFrame([(7, list("xabc")), (8, list("cab")), (9, [])], "p int, w array<string>")
    got = sorted(map(tuple, retrieval.shared_runs(texts, "t", probes, "p", 3).collect()))
    assert got == [(1, 7, 1), (1, 8, 1), (2, 7, 1), (2, 8, 1)]


def test_knn_leaves_out_what_is_no_vector(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 1.0], "b"), (4, None, "b"), (5, [float("nan"), 1.0], "b"), (6, [0.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "i int, v array<float>, g string")
    near = retrieval.knn(df.where("i = 1"), df, "i", "v", 2, 0.1).orderBy("rank").select("id").collect()
    assert [r[0] for r in near] == [2, 3]
    assert [r[0] for r in retrieval.knn(df.where("i = 1"), df, "i", "v", 2, 0.1, apart="g").select("id").collect()] == [3]
