"""Linked parts of secrets, the fit of quality scores, and pivots of hard vectors."""

import random
import re

import numpy as np
import pytest

from sparkloom.llm import pivots, quality, secrets
from sparkloom.llm.pivots import embedding_groups
from sparkloom.llm.quality import fit_pu, fit_quality, gradients, quality_scores

from test_spans import secret_base
from test_vectors_quality_lines import brute_links


# --- secrets


def brute_linked(text):
    spans = [(a, k, b) for a, k, b in secret_base(text)]
    for kind, pattern in ((3, secrets.WEAK_ID), (4, secrets.WEAK_SECRET), (5, secrets.WEAK_ENDPOINT)):
        for m in re.finditer(pattern, text):
            if kind != 4 or all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]")):
                spans.append((m.start(), kind, m.end()))
    rank = lambda s: secrets.RANKS[secrets.KINDS[s[1]]]
    role = lambda s: secrets.ROLES[secrets.KINDS[s[1]]]
    parts = [s for s in spans if not any(rank(o) < rank(s) and s[0] < o[2] and o[0] < s[2] for o in spans)]
    out = []
    for s in parts:
        near = {role(o) for o in parts if max(o[0] - s[2], s[0] - o[2]) < secrets.SCOPE}
        if s[1] > 2 and ({0: {1}, 2: {0, 1}}.get(role(s), set()) <= near if role(s) != 1 else near & {0, 2}):
            out.append(s)
    return sorted(secret_base(text) + out)


def found(spark, texts):
    rows = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["id"]: [tuple(x) for x in r["spans"]] for r in rows}


def test_no_part_complements_itself(spark):
    texts = [
        "see https://cdn.example.com/AbCdEf1234567890abcdefGH for more", "client_id: AbCdEf1234567890abcdefGH", "https://x.example/?login=bobby only",
        "login: bobby AbCdEf1234567890abcdefGH", "https://x.example/a and AbCdEf1234567890abcdefGH", "account=joe https://db.example/ AbCdEf1234567890abcdefGH",
    ]
    got = found(spark, texts)
    assert [got[k] for k in range(3)] == [[], [], []]
    assert [[x[1] for x in got[k]] for k in (3, 4, 5)] == [[3, 4], [4], [3, 5, 4]]
    assert got == {k: brute_linked(t) for k, t in enumerate(texts)}


def test_linked_spans_of_any_text(spark):
    rng = random.Random(12)
    pieces = ["login: bobby ", "client_id=AbCdEf1234567890abcdefGH ", "AbCdEf1234567890abcdefGH ", "https://h.example/p1 ", "https://h.example/AbCdEf1234567890abcdefGH ", "redis://u:p@h:1/?user=x12 ", "db.example:5432 ", "password=abcdef12 ", "AKIA" + "Z9" * 9 + " ", "0123456789abcdef" * 2 + " ", "é" * 40 + " ", "word " * 60, "x" * 230 + " "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(250)]
    assert found(spark, texts) == {k: brute_linked(t) for k, t in enumerate(texts)}


# --- quality


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_gradient_of_the_risk(shift):
    """Against differences, where the negative part is positive and where it is clipped."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(24, 5))
    x[:12] += shift
    w = [rng.normal(size=(5, 3)), rng.normal(size=3), np.array([1.0, 0.7, 0.4]) + shift, np.array([-shift])]
    if shift:
        x[12:] = -np.abs(x[12:]) * 3
        w[0] = np.abs(w[0])
    prior = 0.6

    def parts(w):
        g = np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
        return prior * np.logaddexp(0, -g[:12]).mean(), np.logaddexp(0, g[12:]).mean() - prior * np.logaddexp(0, g[:12]).mean()

    clipped = parts(w)[1] < 0
    assert clipped == bool(shift)
    risk = (lambda w: -parts(w)[1]) if clipped else (lambda w: sum(parts(w)))
    for k, grad in enumerate(gradients(w, x, 12, prior)):
        for at in np.ndindex(w[k].shape):
            up, down = ([v.copy() for v in w] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((risk(up) - risk(down)) / 2e-6 - np.reshape(grad, w[k].shape)[at]) < 1e-6


def test_row_order_does_not_matter(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    docs = [(k, " ".join(word() + ("&&&" if k % 4 == 0 else "") for _ in range(30))) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 240, 2)], "doc_id long, quality int")
    scores, models = [], []
    for parts in (1, 7):
        rng.shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        model = fit_quality(df, labels, quality.F.lit(True))
        models.append(model)
        scores.append({r["id"]: r["score"] for r in quality_scores(df, model).collect()})
    assert models[0]["prior"] == models[1]["prior"] and all(np.array_equal(a, b) for a, b in zip(*(m["w"] for m in models), strict=True))
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-12  # products of matrices of other heights


def test_few_rows_are_fitted_too():
    rng = np.random.default_rng(4)
    few = fit_pu(rng.normal(3, 1, (6, 4)), rng.normal(-3, 1, (9, 4)))
    assert "constant" not in few and 0 < few["prior"] < 1
    assert "constant" not in fit_pu(np.ones((1, 4)), np.zeros((1, 4)))
    assert fit_pu(np.zeros((0, 4)), np.ones((3, 4)))["constant"] == 0.5


# --- pivots


def test_very_large_and_small_vectors_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1.7e308]), (7, [-1e200, 0.0])]
    got = {r["id"]: (r["n_links"], r["component"]) for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_recall_within_clusters(spark):
    """Planted pairs at cosine 0.951 to 0.97 in five clusters of cosine 0.8."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(np.sqrt(0.8) * unit(rng.normal(size=(5, 64)))[rng.integers(0, 5, 1200)] + np.sqrt(0.2) * unit(rng.normal(size=(1200, 64))))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.951, 0.97, (1200, 1))
    x = np.concatenate((a, c * a + np.sqrt(1 - c * c) * side))
    points = pivots.apart(x[rng.permutation(len(x))[:196]], 98)
    assert len(points) == 98
    rows = list(enumerate(x.tolist()))
    want = brute_links(rows, 0.95)
    got = {r["id"]: r["n_links"] for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(n for n, _ in want.values()) >= 2400
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[k] <= n for k, (n, _) in want.items())


def test_recall_at_the_most_pivots():
    """The rule itself (described, listed, shared) on random vectors with 4,096 pivots."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    points = unit(rng.normal(size=(pivots.MAX_PIVOTS, 64)))
    a = unit(rng.normal(size=(1500, 64)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.951, 0.97, (1500, 1))
    near = [np.argsort(-(v @ points.T), axis=1)[:, : pivots.DESCRIBED] for v in (a, c * a + np.sqrt(1 - c * c) * side)]
    met = [len(set(p) & set(q)) >= pivots.SHARED and bool(set(p[: pivots.LISTED]) & set(q[: pivots.LISTED])) for p, q in zip(*near, strict=True)]
    assert np.mean(met) >= 0.9
