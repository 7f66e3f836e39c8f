"""Columns of whole queries against brute force, and what must hold for any table."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from sparkloom.llm import common, exact_dedup, packing, queries, tokens
from sparkloom.llm.line_dedup import dedup_lines
from sparkloom.llm.pivots import embedding_groups
from sparkloom.llm.quality import quality_filter
from sparkloom.llm.secrets import redact_secrets
from sparkloom.llm.simhash import simhash_dedup

from test_exact_and_simhash import brute_exact, docs, groups_of
from test_spans import secret_base
from test_vectors_quality_lines import brute_links

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_every_operator_is_registered():
    assert {re.match(r"op\d+|pipeline", n)[0] for n in entry.queries() if n[:2] == "op" or n == "pipeline"} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}


def test_chat_digests(spark):
    turns = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op1_chat(spark, SF).collect()}
    for k, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[k] == (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    assert got.keys() == turns.keys()


def test_secret_columns(spark, table):
    got = {r["doc_id"]: r for r in queries.op2_secrets(spark, SF).collect()}
    for i, t in table:
        base = secret_base(t)
        names = [("assign", "access", "hex")[k] for _, k, _ in base]
        assert [got[i][f"n_{n}"] for n in ("assign", "access", "hex")] == [names.count(n) for n in ("assign", "access", "hex")]
        assert got[i]["base_sha256"] == sha(",".join(f"{n}:{a}:{b}" for n, (a, _, b) in zip(names, base, strict=True)))


def test_simhash_columns(spark, table):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, SF).collect()), key=str)
    assert got == groups_of(table, 3, 2)


def test_packing_columns(spark, table, byte):
    pieces = {}
    for r in queries.op8_packing(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in table:
        ids = np.array([*byte.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_bpe_columns(spark, table):
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word.no_padding()
    word.no_truncation()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_bpe(spark, SF).collect()}
    for i, t in table[:60]:
        ids = word.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(word.decode(ids, skip_special_tokens=False)))
    assert len(got) == len(table)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "é", "'S", "1²", "　", "\x85", "日", "!", "\U0001f600"])).map("".join))
def test_byte_tokens_of_any_text(byte, text):
    assert tokens.encode(tokens.load(tokens.default_path()), text).tolist() == byte.encode(text, add_special_tokens=False).ids


def test_recall_of_planted_pairs(spark):
    """Pairs at cosine 0.951 to 0.97 among 3,000 random vectors."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(1500, 64)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.951, 0.97, (1500, 1))
    rows = list(enumerate(np.concatenate((a, c * a + np.sqrt(1 - c * c) * side)).tolist()))
    want = brute_links(rows, 0.95)
    got = {r["id"]: r["n_links"] for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(n for n, _ in want.values()) >= 3000
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[k] <= n for k, (n, _) in want.items())


def test_merge_rounds_sort(spark, capsys):
    level = spark.createDataFrame([], "run int, shard int, d binary, n int, h long, low long, rows long")
    exact_dedup.merge_round(level, 4).explain()
    assert re.search(r"Window.*Sort", capsys.readouterr().out, re.S)


def test_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    rows = [(k, "hot") for k in range(150)] + [(k, f"pair {k // 2}") for k in range(200, 260)] + [(300, "one"), (None, "hot")]
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs(spark, rows), runs=16, fan_in=4).collect()), key=str) == brute_exact(rows)


CLASH = ("_all", "_worded", "_kept", "_id", "_h", "_k1", "_k2", "_spans", "_gone", "row", "t", "out", "none", "spans", "k1", "k2", "i_", "h_", "id", "h", "key", "component")


@pytest.mark.parametrize("stage", [dedup_lines, redact_secrets, simhash_dedup, lambda d: quality_filter(d, {"constant": 0.4})])
def test_stages_keep_columns_of_any_name(spark, stage):
    rows = [(1, "first text password=abcdef1\nsecond line here", *CLASH), (2, "quite another text of its own", *CLASH), (None, "text without an id", *CLASH)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    out = stage(df)
    assert out.columns == df.columns
    found = out.collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "None"] and all(tuple(r)[2:] == CLASH for r in found)
    assert stage(df.limit(0)).collect() == []


def test_many_spans_in_one_text(spark):
    text = " ".join(f"login: joe{k} password=abcdef{k} xx" for k in range(3000))
    got = redact_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert got == " ".join(["[id] [assign] xx"] * 3000)


def test_packing_spreads_ties_and_long_documents(spark, byte, monkeypatch):
    monkeypatch.setattr(packing, "TOKENS_A_PARTITION", 5000)
    monkeypatch.setattr(packing, "CHUNK", 700)
    same, long = "the same words again and again", "one long text " * 2000
    df = spark.createDataFrame([(None, same)] * 3000 + [(7, long)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"] >> 32] = sizes.get(r["sequence_id"] >> 32, 0) + r["length"]
    assert len(sizes) >= 4 and max(sizes.values()) <= 0.5 * sum(sizes.values())
    back = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["start"]))
    assert np.frombuffer(back, "<u4").tolist() == [*byte.encode(long, add_special_tokens=False).ids, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 3000 * (len(byte.encode(same, add_special_tokens=False).ids) + 1)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_scratch_tables_go(spark, tmp_path):
    with common.scratch(spark) as put:
        held = put(spark.range(3).select(F.col("id")), "short")
        path = held.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert held.count() == 3
    import os

    assert not os.path.exists(path)
