"""Search, clusters, consensus, phrases, near keys and allocation against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import tree
from sparkloom.operators import allocate, calibrate, cluster, consensus, hamming, index, phrases, ranks, retrieval
from sparkloom.sources.staging import scratch, shared_folder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def texts(n, seed, size=30):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return [(k, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, size)))) for k in range(n)]


# --- nearest neighbours


@pytest.mark.parametrize("apart", [None, "g"])
def test_neighbours_in_blocks_equal_one_block(spark, monkeypatch, apart):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist(), "xyz"[k % 3]) for k in range(60)] + [(60, None, "x"), (61, [0.0] * 6, None), (62, [1.0, 2.0], "y")]
    df = spark.createDataFrame(rows, "id long, v array<double>, g string")
    asked = df.where("id % 2 = 0")
    one = sorted(map(tuple, retrieval.knn(asked, df, "id", "v", 3, -1.0, apart).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    several = sorted(map(tuple, retrieval.knn(asked, df, "id", "v", 3, -1.0, apart).collect()))
    assert one == several and len(one) >= 80
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in rows[:60]}
    group = {k: g for k, _, g in rows}
    for q in range(0, 60, 2):
        best = sorted((-float(unit[q] @ unit[i]), i) for i in unit if i != q and not (apart and group[i] == group[q]))[:3]
        assert [i for _, i in best] == [r[1] for r in sorted((r for r in one if r[0] == q), key=lambda r: r[3])]


def test_long_vectors_make_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 8 * 4 * 3)
    df = spark.createDataFrame([(k, [float(k), 1.0, 2.0, 3.0]) for k in range(10)], "id long, v array<double>")
    assert retrieval.knn(df, df, "id", "v", 2).count() == 20


# --- inverted index


def brute_search(docs, queries, k):
    split = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    held = {i: split(t) for i, t in docs}
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(w for ws in held.values() for w in set(ws))
    out = {}
    for q, text in queries:
        score = {}
        for w in {w for w in split(text) if len(w) >= 3 and w in df}:
            idf = max(1e-6, math.log((len(held) - df[w] + 0.5) / (df[w] + 0.5)))
            for i, ws in held.items():
                if w in ws:
                    tf = ws.count(w)
                    score[i] = score.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        for rank, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1):
            out[q, rank] = (i, round(s, 6))
    return out


def test_search_equals_scoring_everything(spark):
    docs = texts(300, 1) + [(900, None), (901, ""), (902, "only mu nu xi"), (903, "RARE Rare-rare tau")]
    queries = [(0, "alpha tau"), (1, "rare alpha beta"), (2, "mu nu"), (3, "nothing here"), (4, None), (5, "omicron, omicron! kappa lambda sigma"), (6, "alpha"), (7, "")]
    ix = index.build(spark.createDataFrame(docs, "id long, text string"), "id", "text", shared_folder(spark, "index-test"))
    asked = spark.createDataFrame(queries, "q long, text string")
    for k in (1, 7, 20):
        got = {(r["query"], r["rank"]): (r["id"], round(r["score"], 6)) for r in index.search(ix, asked, "q", "text", k).collect()}
        assert got == brute_search(docs, queries, k)
    terms = {(r["query"], r["term"]): r["needed"] for r in index.asked_terms(ix, asked, "q", "text").collect()}
    assert terms[0, "tau"] and not terms[0, "alpha"]  # documents with the common word alone are never scored
    with pytest.raises(ValueError):
        index.search(ix, asked, "q", "text", 21)


def test_search_without_broadcasts_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(index, "BROADCAST_TERMS", -1)
    docs, queries = texts(80, 2), texts(9, 3, 6)
    ix = index.build(spark.createDataFrame(docs, "id long, text string"), "id", "text", shared_folder(spark, "index-test"))
    got = {(r["query"], r["rank"]): (r["id"], round(r["score"], 6)) for r in index.search(ix, spark.createDataFrame(queries, "q long, text string"), "q", "text", 5).collect()}
    assert got == brute_search(docs, queries, 5)
    empty = index.build(spark.createDataFrame([], "id long, text string"), "id", "text", shared_folder(spark, "index-test"))
    assert index.search(empty, spark.createDataFrame(queries, "q long, text string"), "q", "text").collect() == []


def test_short_queries_are_looked_for_everywhere(spark, monkeypatch):
    monkeypatch.setattr(index, "LIKE_BLOCK", 2)
    docs = spark.createDataFrame([(k, f"/p/ab{k}") for k in range(30)] + [(30, None), (31, "/X%Y_")], "id long, path string")
    asked = spark.createDataFrame([(1, " AB "), (2, "b2"), (3, ""), (4, None), (5, "%"), (6, "zz"), (7, "x%y_")], "q long, t string")
    got = sorted(map(tuple, index.contains(docs, "id", "path", asked, "q", "t", 3).collect()))
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 2, 1), (2, 20, 2), (2, 21, 3), (5, 31, 1), (7, 31, 1)]


# --- clusters


def brute_clusters(rows, least):
    out, led = [], {}
    for block, k, items in sorted(rows, key=lambda r: r[1]):
        s = set(items or [])
        for name, other in led.setdefault(block, []):
            union = len(s | other)
            if not union or (s and other and len(s & other) / union >= least):
                out.append((k, name))
                break
        else:
            led[block].append((k, s))
            out.append((k, k))
    return sorted(out)


@pytest.mark.parametrize(("first", "pairs"), [(64, 200), (3, 1)])
def test_clusters_equal_the_sequential_rule(spark, monkeypatch, first, pairs):
    monkeypatch.setattr(cluster, "FIRST_ROUND", first)
    monkeypatch.setattr(cluster, "PAIRS_A_SET", pairs)
    rng = random.Random(first)
    rows = []
    for k in range(160):
        base = rng.choice([list("abcdefghij"), list("abcdefghkl"), list("mnopqr"), []])
        rows.append((rng.choice(["p", "p", "p", "q", None]), k, [x for x in base if rng.random() < 0.9] + [rng.choice("uvwxyz")] * (rng.random() < 0.3)))
    rows += [("p", 500, None), ("p", 501, []), ("r", 502, ["a", "a", None])]
    df = spark.createDataFrame(rows, "block string, k long, items array<string>")
    rows = [(b, k, [x for x in i or [] if x is not None]) for b, k, i in rows]
    assert sorted(map(tuple, cluster.leader_clusters(df, "block", "k", "items", 0.8).collect())) == brute_clusters(rows, 0.8)
    assert cluster.leader_clusters(df.limit(0), "block", "k", "items", 0.8).collect() == []


# --- consensus


def brute_consensus(titles, least=10):
    n, where = Counter(), {}
    for at, t in titles:
        low = t.lower()
        seen = set()
        for i in range(len(t)):
            for j in range(i + least, len(t) + 1):
                s = low[i:j]
                if s[0] != " " and s[-1] != " ":
                    if s not in seen:
                        n[s] += 1
                    seen.add(s)
                    where.setdefault(s, (at, i, t[i:j]))
    if not n or max(n.values()) < 2:
        return None, None
    top = max(n.values())
    s = max((s for s in n if n[s] == top), key=lambda s: (len(s), tuple(-x for x in where[s][:2])))
    return where[s][2], top


def test_consensus_of_groups(spark):
    rng = random.Random(8)
    groups = {"antler": ["Woof Honest Chew Natural Antler Dog Chew, Small - Amazon.com", "Woof Honest Chew Antler Small | Chewy", "woof honest chew antler sm dog treat – Petco"], "two": ["The   Very Long Name of It", "Not The very long Name"], "none": ["short", "texts"], "one": ["A single long title here"], "copies": ["Exactly the same title"] * 3, "blank": ["", None, "  "], None: ["Without any group at all", "without any group at all!"]}
    for g in range(12):
        groups[f"r{g}"] = ["".join(rng.choices("ab ", k=rng.randint(8, 30))) for _ in range(rng.randint(1, 6))]
    rows = [(g, k, t) for g, ts in groups.items() for k, t in enumerate(ts)]
    got = {r["g"]: (r["name"], r["support"]) for r in consensus.consensus(spark.createDataFrame(rows, "g string, k long, t string"), "g", "k", "t").collect()}
    assert got["antler"] == ("Woof Honest Chew", 3) and got["two"] == ("The Very Long Name", 2) and got["copies"] == ("Exactly the same title", 3)
    bare = {r["i"]: r["t"] for r in spark.createDataFrame([(f"{g}/{k}", t) for g, k, t in rows], "i string, t string").select("i", consensus.bare_title(F.col("t")).alias("t")).collect()}
    for g, ts in groups.items():
        name, support = brute_consensus([(k, bare[f"{g}/{k}"]) for k in range(len(ts)) if bare[f"{g}/{k}"]])
        assert got[g] == (name.strip(",-–—|: ") if name else None, support), g


def test_consensus_of_two_titles_is_their_common_part(spark):
    rng = random.Random(9)
    rows = []
    for g in range(15):
        core = " ".join(rng.choices(WORDS, k=3))
        rows += [(g, k, f"{' '.join(rng.choices(WORDS, k=2))} {core} {rng.choice(WORDS)}") for k in range(2)]
    got = {r["g"]: r["name"] for r in consensus.consensus(spark.createDataFrame(rows, "g long, k long, t string"), "g", "k", "t").collect()}
    for g in range(15):
        a, b = (t for h, _, t in rows if h == g)
        longest = max(len(x) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if (x := a[i:j].strip()) in b)
        assert len(got[g]) == longest and got[g] in a and got[g] in b


# --- phrases


def test_phrases_of_any_length(spark):
    docs = texts(60, 4, 40) + [(100, None), (101, "")]
    rng = random.Random(4)
    labels = [(k, " ".join(rng.choices(WORDS[:5], k=1 + k % 6))) for k in range(30)] + [(50, None), (51, "alpha"), (52, "alpha"), (53, " ".join(WORDS + WORDS))]
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    d = spark.createDataFrame(docs + [(7, "one " + " ".join(WORDS + WORDS) + " two")], "id long, t string").select("id", split("t").alias("w"))
    held = spark.createDataFrame(labels, "label long, t string").select("label", split("t").alias("l"))
    docs.append((7, "one " + " ".join(WORDS + WORDS) + " two"))
    want = []
    for i, t in docs:
        w = (t or "").split()
        for k, x in labels:
            p = (x or "").split()
            want += [(i, k, at, len(p)) for at in range(len(w) - len(p) + 1) if p and w[at : at + len(p)] == p]
    got = sorted(map(tuple, phrases.phrase_matches(d, "id", "w", held, "label", "l").collect()))
    assert got == sorted(want) and any(r[3] == 38 for r in got)
    top = {}
    for i, _, at, n in want:
        top[i, at] = max(top.get((i, at), 0), n)
    unique = [r for r in want if r[0] != 7]
    best = phrases.phrase_matches(d.where("id <> 7"), "id", "w", held, "label", "l", longest=True)
    assert sorted(map(tuple, best.collect())) == sorted(r for r in unique if r[3] == max(n for i, _, at, n in unique if (i, at) == (r[0], r[2])))
    assert phrases.phrase_matches(d, "id", "w", held.limit(0), "label", "l").collect() == []


def test_prefixes_of_any_length(spark):
    names = spark.createDataFrame([(1, "Big Blue Box Of Many Things here"), (2, "big blue"), (3, "Bigger"), (4, "x y"), (5, None)], "id long, name string")
    keys = spark.createDataFrame([("Big",), ("BIG blue",), ("big blue box of many things",), ("bigg",)], "brand string")
    got = {r["id"]: r["match"] for r in phrases.longest_prefix(names, "name", keys, "brand").collect()}
    assert got == {1: "big blue box of many things", 2: "BIG blue", 3: None, 4: None, 5: None}
    assert {r["match"] for r in phrases.longest_prefix(names, "name", keys.limit(0), "brand").collect()} == {None}


# --- near keys


@pytest.mark.parametrize(("radius", "blocks"), [(10, 4), (3, 4), (9, 8), (0, 2)])
def test_near_keys(spark, radius, blocks):
    rng = random.Random(radius)
    rows = []
    for k in range(60):
        base = [rng.choice("01") for _ in range(rng.choice([64, 56]))]
        rows.append((10 * k, "".join(base)))
        for j in range(2):
            for i in rng.sample(range(len(base)), rng.randint(0, 7)):
                base[i] = "10"[int(base[i])]
            rows.append((10 * k + 1 + j, "".join(base)))
    df = spark.createDataFrame(rows + [(9001, None), (9002, ""), (9003, "0" * 65), (9004, "012"), (9005, "0" * 63), (9006, "1" * 64)], "id long, bits string")
    first, n = {}, Counter(b for _, b in rows)
    for i, b in rows:
        first[b] = min(i, first.get(b, i))
    keys = [*first] + ["0" * 63, "1" * 64]
    first |= {"0" * 63: 9005, "1" * 64: 9006}
    want = []
    for x in keys:
        for y in keys:
            if first[x] < first[y] and len(x) == len(y) and (d := sum(a != b for a, b in zip(x, y, strict=True))) <= radius:
                want.append((first[x], first[y], d, n[x] or 1, n[y] or 1))
    assert sorted(map(tuple, hamming.near_keys(df, "id", "bits", radius, blocks).collect())) == sorted(want)


# --- names


def brute_allocate(rows, taken):
    used, out = {t.lower() for t in taken}, []
    for key, name in sorted(r for r in rows if r[1]):
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if dot else (name, ".html")
        at, asked = 1, name
        while asked.lower() in used:
            at += 1
            asked = stem[: 80 - len(f"-{at}")].rstrip("-") + f"-{at}" + ext
        used.add(asked.lower())
        out.append((key, asked, name))
    return out


def test_names_equal_the_sequential_rule(spark):
    rng = random.Random(6)
    stems = ["a", "A", "a-2", "a-2-2", "a-3", "b", "x" * 80, "x" * 79 + "-", "x" * 78 + "-2", "c.d"]
    rows = [(k, rng.choice(stems) + ".html") for k in rng.sample(range(1000), 150)] + [(2000, "plain"), (2001, "plain"), (2002, None), (2003, "")]
    taken = ["a-4.html", "A-7.HTML", "b.html", "plain-2.html"]
    got = allocate.allocate_names(spark.createDataFrame(rows, "k long, name string"), "k", "name", spark.createDataFrame([(t,) for t in taken], "t string"))
    assert sorted(map(tuple, got.collect())) == brute_allocate(rows, taken)
    three = allocate.allocate_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2")], "k long, name string"), "k", "name").collect()
    assert sorted(map(tuple, three)) == brute_allocate([(1, "a"), (2, "a"), (3, "a-2")], []) and len({r["name"] for r in three}) == 3
    assert allocate.allocate_names(spark.createDataFrame([], "k long, name string"), "k", "name").collect() == []


# --- ranks and trees


def test_places_and_running_sums(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randint(0, 40), k, rng.randint(0, 9)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, k int, n int").repartition(7)
    with scratch(spark) as put:
        got = ranks.places(df, ["g"], ["v", "k"], "place", put).collect()
        sums = ranks.running(df, ["g"], ["v", "k"], "n", "upto", put).collect()
        alone = ranks.running(df, [], ["k"], "n", "upto", put).collect()
    for g in ("hot", "cold", None):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3])
        assert [r["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])] == [r[2] for r in order]
        assert sorted(r["place"] for r in got if r["g"] == g) == list(range(1, len(order) + 1))
        upto = {r["k"]: r["upto"] for r in sums if r["g"] == g}
        assert [upto[r[2]] for r in order] == np.cumsum([r[3] for r in order]).tolist()
    assert {r["k"]: r["upto"] for r in alone} == dict(zip(range(400), np.cumsum([r[3] for r in rows]).tolist(), strict=True))


def test_steps_in_a_tree(spark):
    paths = [(["a", "b", "c"], ["a", "b", "c"]), (["a", "b"], ["a", "c"]), (["a"], ["b"]), (["a", "b", "c"], ["a"]), ([], ["a", "b"]), (None, ["a"]), (["a", "x", "c"], ["a", "y", "c"])]
    got = spark.createDataFrame(paths, "a array<string>, b array<string>").select(tree.common_depth(F.col("a"), F.col("b")), tree.distance(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(3, 0), (1, 2), (0, 2), (1, 2), (0, 2), (0, 1), (1, 4)]


def test_calibration_by_depth(spark):
    rows = [(1, 0.95, ["r"], ["r"]), (1, 0.9, ["r"], ["s"])] + [(2, k / 20, ["r", "a"], ["r", "a" if k % 2 else "b"]) for k in range(20)]
    got = {r["depth"]: r for r in calibrate.depth_calibration(spark.createDataFrame(rows, "d int, c double, g array<string>, p array<string>"), "d", "c", "g", "p").collect()}
    assert not got[1]["sufficient"] and got[2]["sufficient"]
    assert (got[1]["exact"], got[1]["ancestor"], got[1]["tree_distance"]) == (0.5, 0.5, 1.0)
    assert (got[2]["exact"], got[2]["ancestor"], got[2]["tree_distance"]) == (0.5, 1.0, 1.0)
    conf = sorted(r[1] for r in rows)
    assert got[1]["abstain_below"] == round(conf[int(len(conf) * 0.15)], 3) and got[2]["abstain_below"] == 0.15 and got[2]["review_above"] == 0.9
    bins = [[r for r in rows if r[0] == 2 and min(9, int(r[1] * 10 + 1e-12)) == b] for b in range(10)]
    assert abs(got[2]["ece"] - sum(abs(sum(r[2] == r[3] for r in b) - sum(r[1] for r in b)) for b in bins) / 20) < 1e-9
