import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import queries, tokens
from sparkloom.llm.bpe import WordBPE, bpe_roundtrip
from sparkloom.llm.chat import CONTROLS, assemble, chat_format, chat_read, escape, read_back, unescape
from sparkloom.llm.packing import hilbert_key, pack

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "a", "Hello, World's  best\n\n thing", "<|endoftext|> a<|startoftext|>b <|im_end|>", "é café", "日本語 テスト", "😀 👨‍👩‍👧", "½ ² ٣",
    "a" * 3000, "ab" * 700, "</w> </w", "ΣΑΣ ΟΔΟΣ", "İstanbul", "ﬁ ß ẞ ſ K", "\x1c\x1f\x85\xa0x y　", "tab\tand\r\nline", "!!!??..,", "x\x00y", "don’t 'S 'll",
]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_escape_is_reversible():
    for s in ["", "<|im_end|>", "<\\|x", "<\\\\|", "a<|<|", "<\\|im_start|>", *CONTROLS]:
        assert unescape(escape(s)) == s
        assert not any(c in escape(s) for c in CONTROLS)


def test_chat_reads_back():
    model = tokens.load(tokens.default_path())
    turns = [("system", ""), ("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_sep|> fine\n"), ("we\nird<|", "x"), ("assistant", "日本 <\\|")]
    ids, mask = assemble(model, turns)
    back, loss, shown = read_back(model, ids, mask)
    assert back == turns
    assert loss == "<|im_sep|> fine\n日本 <\\|"
    assert shown.count("<|im_start|>") == len(turns)
    assert assemble(model, [])[0].size == 0


def test_chat_orders_turns_and_keeps_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (None, 0, None, "z"), (2, None, "user", "late"), (2, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"]) for r in chat_read(chat_format(df)).collect()}
    assert got[1] == ([("user", ""), ("assistant", "b"), ("assistant", "b")], "bb")
    assert got[None] == ([("", "z")], "")
    assert got[2][0][0] == ("user", "late") and len(got[2][0][1][1]) == 100_000
    assert chat_format(df.limit(0)).collect() == []


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in queries.op1_chat(spark, SF).collect()}
    both = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{both}\nassistant\n{both}\n".encode()).hexdigest()
    assert (got[-1]["loss_chars"], got[-1]["loss_sha256"]) == (len(both), hashlib.sha256(both.encode()).hexdigest())
    rows = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values("turn")
    for k, g in rows.groupby("conv_id"):
        said = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text, strict=True))
        loss = "".join(g.text[g.role == "assistant"])
        assert got[k]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[k]["n_turns"], got[k]["loss_chars"]) == (len(g), len(loss))
    assert len(got) == rows.conv_id.nunique() + 1


def test_word_bpe_equals_the_library(word):
    model = WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(4)
    alphabet = list("abcdeétn '.!1Σ\n<|>ｱ")
    for text in ODD + ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(3000)]:
        want = word.encode(text, add_special_tokens=False).ids
        got = model.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert model.decode(got).decode() == word.decode(want, skip_special_tokens=False)


def test_bpe_over_rows(spark, word):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "a b", "x"), (7, None, "x"), (7, None, "x")], "doc_id long, text string, ids string")
    got = bpe_roundtrip(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((str(r["id"]), len(r["ids"]) // 4) for r in got) == sorted(
        [(str(k), len(word.encode(t, add_special_tokens=False).ids)) for k, t in enumerate(ODD)] + [("None", 2), ("7", 0), ("7", 0)]
    )


def test_byte_ids_equal_the_library(byte):
    model = tokens.load(tokens.default_path())
    for text in ODD:
        assert tokens.encode(model, text).tolist() == byte.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours_touch():
    n = 8
    cells = np.array([(a, b, c) for a in range(n) for b in range(n) for c in range(n)])
    key = hilbert_key(cells, 3)
    assert sorted(key) == list(range(n**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_keeps_every_id_once(spark, byte):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (101, "word " * 9000), (None, "none"), (5, "a"), (200, "same"), (201, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int")
    got = pack(df, length=256).toPandas().sort_values(["sequence_id", "offset"])
    used = got.groupby("sequence_id")["length"].sum()
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
    assert used.max() <= 256 and (used < 256).sum() <= 1
    made = sorted(zlib.crc32(np.append(byte.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4").tobytes()) for _, t in rows)
    got["key"] = got["doc_id"].astype(str) + ":" + got["doc_tokens"].astype(str)
    whole = [zlib.crc32(b"".join(g.sort_values("start")["ids"])) for _, g in got.groupby("key")]
    assert sorted(whole) == made
    assert pack(df.limit(0)).collect() == []
