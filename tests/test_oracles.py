"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "-"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "-" if math.isnan(v) else repr(round(v, 6))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_is_registered():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_code_join_loses_no_pair(spark):
    sf, duck = "/root/testdata/sf0.01", duckdb.connect()  # the smallest with parts that share a code
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    got = entry.queries()["q_gtin_join"](spark, sf).toPandas()
    a, b = (got[got["half"] == h] for h in "ab")
    pairs = a.merge(b, on="class_id")
    code = "CASE WHEN length(code) IN (8, 12, 13, 14) THEN lpad(code, 14, '0') ELSE code END"
    want = duck.sql(f"""
        WITH a AS (SELECT p_partkey AS a, lpad((p_partkey % 501)::VARCHAR, 12, '0') AS code FROM part WHERE p_partkey % 2 = 0),
             b AS (SELECT p_partkey AS b, CASE WHEN p_partkey % 3 = 0 THEN lpad((p_partkey % 501)::VARCHAR, 14, '0') ELSE lpad((p_partkey % 501)::VARCHAR, 10, '0') END AS code FROM part WHERE p_partkey % 2 = 1),
             x AS (SELECT a, {code} AS code FROM a), y AS (SELECT b, {code} AS code FROM b)
        SELECT a, b FROM x JOIN y USING (code)""").fetchall()
    parts = duck.sql("SELECT count(*) FROM part").fetchall()[0][0]
    assert want and len(got) == parts
    assert sorted(zip(pairs["p_partkey_x"], pairs["p_partkey_y"], strict=True)) == sorted(want)
    assert got["links"].sum() == 2 * len(want)
    assert rows(got) == rows(duck.sql(entry.oracle_sql()["q_gtin_join"]).df())
