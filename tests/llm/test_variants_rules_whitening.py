"""Spelling variants, the rule ledger and whitening against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import queries, rules, variants, whitening
from sparkloom.llm.wavelet import Wavelet, Words

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"


# --- spelling variants


def brute_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return sorted((w, c) for w, c in n.items() if len(w) >= 7 and c >= 2)


def brute_variants(rows):
    n, near, holes = dict(rows), defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            holes[i, rest].append(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for alike in holes.values():
        for w in alike:
            near[w].update(u for u in alike if u != w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def found_variants(spark, rows):
    return sorted(map(tuple, variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()))


def test_words_of_texts(spark):
    rows = [(1, "Largely LARGELY largely"), (2, "Éclaircir éclaircir éclaircir étage×étage×étage"), (None, "nothing nothing"), (4, None), (5, ""), (1, "Largely LARGELY largely")]
    rows += [(k, "wonderful enormous wonderful") for k in range(200)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n int")
    assert sorted(map(tuple, variants.words_of(df).collect())) == brute_counts(rows)
    assert variants.words_of(df.limit(0)).collect() == []


def test_variants_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_variants(spark, SF).collect())) == brute_variants(brute_counts(rows))


def test_variants_by_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = "word, form, root, n, n_near, form_n"
    theirs = c.sql(f"SELECT {cols} FROM ({queries.ORACLE_SQL['op11_variants']})").fetchall()
    assert sorted(map(tuple, queries.op11_variants(spark, SF).select(*cols.split(", ")).collect())) == sorted(theirs)


@pytest.mark.parametrize("size", [4, 25, 1 << 14])
def test_variants_in_shards_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(variants, "SHARD_WORDS", size)
    rng = np.random.default_rng(size)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 6))) for _ in range(250)} | {"stem" + "".join(rng.choice(list("xy"), 4)) + "tail" for _ in range(16)}
    rows = [(w, int(10 ** rng.integers(0, 4))) for w in sorted(words)]
    assert found_variants(spark, rows) == brute_variants(rows)


def test_variants_of_odd_words(spark):
    long = "longword" * 4000
    rows = [(long, 2), (long + "s", 30), (long[:9] + "Z" + long[9:], 30), ("aa", 1), ("aaa", 10), ("aaaa", 100), ("aaab", 100), ("\U0001f600a", 1), ("\U0001f601a", 10), ("b", 5)]
    assert found_variants(spark, rows) == brute_variants(rows)
    assert found_variants(spark, [("", 3), (None, 2)]) == [] == found_variants(spark, [])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=4, max_size=4), min_size=1), st.sets(st.text("abc", min_size=3, max_size=4), min_size=1), st.integers(0, 4))
def test_positions_divide_the_work(members, asked, cut):
    """Each pair is found once, by its own position."""
    index = Words(sorted(members), [1] * len(members))
    for size in (3, 4):
        queries_ = np.array(sorted(a for a in asked if len(a) == size), dtype=f"<U{size}")
        if not len(queries_):
            continue
        got = []
        for a, b in ((0, cut), (cut, 4)):
            q, w = index.near(queries_, np.full(len(queries_), a), np.full(len(queries_), b))
            got += [(str(queries_[i]), str(index.words[j])) for i, j in zip(q, w, strict=True)]
        near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(4))
        assert sorted(got) == sorted((str(a), b) for a in queries_ for b in members if near(str(a), b))


@settings(max_examples=60, deadline=None)
@given(st.permutations(range(23)), st.lists(st.tuples(*[st.integers(0, 23)] * 4), min_size=1, max_size=8))
def test_wavelet_reports_rectangles(order, asked):
    lo, hi, least, below = np.array([(min(a, b), max(a, b), min(c, d), max(c, d)) for a, b, c, d in asked]).T
    q, v = Wavelet(np.array(order)).report(lo, hi, least, below)
    assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == sorted((k, x) for k in range(len(lo)) for x in order[lo[k] : hi[k]] if least[k] <= x < below[k])


# --- rule ledger

BLANK = " \t\n\v\f\r"


def brute_measures(text):
    text = text or ""
    words = re.findall(f"[^{BLANK}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{BLANK}]", x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if n[r] > 1 for k in range(8)}
    letters = [c for c in text if c.isascii() and c.isalpha() or ord(c) > 127]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), len(letters), sum("A" <= c <= "Z" for c in text))


ODD = [
    "", " \n\t ", None, "one", "a b c d e f g h", "x " * 8, "x " * 9, "a b c d e f g h " * 3, "same\nsame\n\n \nsame ", "\x1c\x1d\x85\xa0 wide　blank", "é日\U0001f600 <#> $5 %",
    "SHOUT " * 30, "a\x00b c", "word " * 7 + "end", " ".join(f"w{k % 50}" for k in range(500)), "\r\nA\r\nA\r\n",
]


def test_measurements_of_odd_texts(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "one", "y"), (None, "one", "y")], "doc_id long, text string, n_words string")
    got = sorted((tuple(r) for r in rules.measure(df).collect()), key=str)
    assert got == sorted([(k, *brute_measures(t)) for k, t in enumerate(ODD)] + [(None, *brute_measures("one"))] * 2, key=str)
    assert rules.ledger(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\tabAé#日\x85"), max_size=120))
def test_measurements_of_any_text(text):
    assert rules.counts(text.encode()) == brute_measures(text)


def test_a_very_long_text(spark):
    text = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 60_000
    assert rules.counts(text.encode())[5] == 600_000
    row = rules.ledger(spark.createDataFrame([(1, text)], TEXTS)).first()
    assert row["n_words"] == 600_000 and row["failed"] == rules.bit("repeated_words")


def test_bits_and_policies(spark):
    texts = {"few_words": "too few", "symbols": " ".join(f"word{chr(65 + k)}#" for k in range(25)), "capitals": " ".join(f"LOUD{chr(65 + k)}" for k in range(25)), "few_letters": " ".join(f"{k}{k}{k}{k}a" for k in range(100, 130)), "long_words": " ".join("q" * 40 + chr(97 + k) for k in range(22))}
    texts["repeated_words"] = "one two three four five six seven eight nine ten " * 3
    texts["repeated_lines"] = "\n".join(f"first{k} of other lines{k} with words{k} in it{k}\nshort line here\ntiny piece" for k in "abcdef")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], TEXTS)
    got = {r["id"]: r["failed"] for r in rules.ledger(df).collect()}
    assert got == {k: rules.bit(name) for k, name in enumerate(texts)}
    kept = {p: {r["doc_id"] for r in rules.rule_filter(df, p).collect()} for p in rules.POLICIES}
    assert kept == {p: {k for k, name in enumerate(texts) if name not in rules.POLICIES[p]} for p in rules.POLICIES}
    loud = spark.range(1).select(rules.passes(rules.F.lit(rules.bit("capitals")), "v2"), rules.passes(rules.F.lit(rules.bit("capitals")), "v2", ("capitals",)))
    assert tuple(loud.first()) == (False, True)


def test_ablation_counts(spark):
    bits = [0, 0, 1, 3, 4, 64, 4, 127, 12]
    got = {(r["policy"], r["rule"]): tuple(r)[2:] for r in rules.ablation(spark.createDataFrame([(b,) for b in bits], "failed long")).collect()}
    for p, names in rules.POLICIES.items():
        for name in names:
            own, all_ = rules.bit(name), rules.mask(p)
            assert got[p, name] == (len(bits), sum(b & own > 0 for b in bits), sum(b & all_ == own for b in bits), sum(b & all_ == 0 for b in bits), sum(b & all_ & ~own == 0 for b in bits))
    assert all(tuple(r)[2:] == (0,) * 5 for r in rules.ablation(spark.createDataFrame([], "failed long")).collect())


def test_rule_filter_keeps_rows_and_columns(spark):
    good = " ".join(f"word{chr(97 + k)}" for k in range(25))
    df = spark.createDataFrame([(1, good, "r", "d"), (1, "few", "r", "d"), (None, good, "r", "d"), (None, good, "r", "d"), (3, None, "r", "d")], TEXTS + ", row string, doc string")
    out = rules.rule_filter(df)
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, good, "r", "d")] + [(None, good, "r", "d")] * 2, key=str)


@pytest.mark.parametrize("name", ["op12_rules", "rule_ablation"])
def test_rules_by_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours = queries.QUERIES[name](spark, SF)
    theirs = c.sql(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)


def test_clean_documents_stay(spark):
    """Of rows labelled good only those go that fail the base rules."""
    good = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    assert good and all(r["kept"] or r["base_failed"] for r in queries.op12_rules(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in good)


# --- whitening

VECTORS = "vec_id long, embedding array<double>"


def brute_whitened(rows, wanted=4):
    usable = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array(sorted({v for _, v in usable}), np.int64)
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    z = (np.array([v for _, v in usable]) - s / n) @ vectors[:, :wanted] / np.sqrt(values[:wanted])
    far = [sum((n * a - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for _, v in usable]
    return usable, n, far, z, values / values.sum(), vectors


def check_whitened(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    usable, n, far, z, share, _ = brute_whitened(rows)
    assert len(got) == 4 * len(usable)
    for c in range(4):
        mine = sorted((r for r in got if r["component"] == c + 1), key=lambda r: (r["id"] is None, r["id"], r["whitened"]))
        order = sorted(range(len(usable)), key=lambda k: (usable[k][0] is None, usable[k][0]))
        a, b = np.array([r["whitened"] for r in mine]), z[order, c]
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-8
        assert [r["deviation"] for r in mine] == [far[k] for k in order] and {r["n"] for r in mine} == {n}
        assert all(abs(r["explained"] / share[c] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in mine)


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(spark, rows)
    assert queries.op13_whitening(spark, SF).columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) * [5, 4, 3, 2, 1, 0.1]).tolist()) for k in range(60)]
    check_whitened(spark, rows + [rows[7], rows[7], (99, rows[8][1]), (100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0])])


def test_whitening_without_variance(spark):
    def n(rows):
        return whitening.whiten(spark.createDataFrame(rows, VECTORS)).count()

    assert n([]) == n([(1, None)]) == n([(1, [])]) == n([(1, [1.0, 2.0])]) == n([(1, [1.0]), (2, [1.001])]) == 0
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0, 1.0, 1.0]) for k in range(9)], VECTORS)).collect()
    assert len(line) == 9 and {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    short = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 3.0]), (3, [4.0, 0.0]), (4, [4.0])], VECTORS)).collect()
    assert {r["n"] for r in short} == {3} and len(short) == 8


def test_deviations_beyond_a_long():
    got, _ = whitening.deviations(np.array([[2**40, 0], [1, 2], [2**62, -(2**62)]]), 10**6, (5, -7))
    assert got == [None, (10**6 - 5) ** 2 + (2 * 10**6 + 7) ** 2, None]
    edge = np.array([[3037000499, 0], [3037000500, 0]])
    assert whitening.deviations(edge, 1, (0, 0))[0] == [3037000499**2, None]


@pytest.mark.parametrize(("width", "basis"), [(40, 256), (300, 64)])
def test_lanczos_with_restarts_and_breakdown(width, basis):
    """Repeated eigenvalues, a matrix of low rank, and a basis that is cut down."""
    rng = np.random.default_rng(width)
    q = np.linalg.qr(rng.normal(size=(width, width)))[0]
    for values in (np.arange(width, 0, -1.0) ** 2, np.array([9.0, 9, 9, 4, 4, 1] + [0.0] * (width - 6)), np.array([5.0] + [0.0] * (width - 1)), np.r_[[8.0] * 20, np.ones(width - 20)]):
        m = (q * values) @ q.T
        got, vectors, _ = whitening.lanczos(lambda b, m=m: m @ b, width, 4, block=8, basis=basis)
        assert np.abs(got - values[:4]).max() < 1e-11 * values[0]
        assert np.abs(m @ vectors - vectors * got).max() < 1e-11 * values[0] and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
