import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm.line_dedup import dedup_lines, kept_lines
from sparkloom.llm.pivots import embedding_groups
from sparkloom.llm.quality import estimate_prior, features, fit_pu, posterior, quality_filter, quality_scores
from sparkloom.llm.queries import op6_quality

SF = "/root/testdata/sf0.01"


def brute_links(rows, floor):
    n = len(rows)
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= floor
    label = np.arange(n)
    for _ in range(n):
        new = np.array([label[near[k]].min() for k in range(n)])
        if (new == label).all():
            break
        label = new
    ids = [i for i, _ in rows]
    low = {c: min(ids[k] for k in range(n) if label[k] == c) for c in set(label)}
    return {ids[k]: (int(near[k].sum()) - 1, low[label[k]]) for k in range(n)}


def test_vector_groups_match_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 20] + 0.02 * rng.normal(size=16)).tolist()) for k in range(80)] + [(300 + k, base[3].tolist()) for k in range(30)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16), (905, [])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + bad], "vec_id long, embedding array<double>, label int, key string")
    got = {r["id"]: (r["n_links"], r["component"]) for r in embedding_groups(df).collect()}
    want = brute_links(rows, 0.95)
    assert {k: got[k] for k in want} == want
    assert all(got[k] == (0, k) for k, _ in bad)
    assert embedding_groups(df.limit(0)).collect() == []


def test_prior_and_posterior_of_two_kinds():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, (6000, 5)), rng.normal(-2, 1, (6000, 5))
    unlabelled = np.concatenate((good[3000:5100], bad[:900]))
    prior = estimate_prior(good[:3000], unlabelled)
    assert abs(prior - 0.7) < 0.08
    model = fit_pu(good[:3000], unlabelled)
    assert (posterior(model, good[5100:]) >= 0.3).mean() > 0.97
    assert (posterior(model, bad[3000:]) < 0.3).mean() > 0.97
    assert (posterior(fit_pu(good[:3], unlabelled), good[:2]) > 0.5).all()  # few rows are fitted as well


def test_features_of_odd_texts():
    for t in ["", " ", "\n\n", "x", "é" * 9, "word " * 50_000]:
        assert np.isfinite(features(t)).all()


def test_quality_on_held_out_labels(spark):
    got = op6_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_quality_rows(spark):
    model = {"constant": 0.4}
    df = spark.createDataFrame([(1, "a", "s"), (None, None, "s"), (1, "a", "s")], "doc_id long, text string, score string")
    assert [r["score"] for r in quality_scores(df, model).collect()] == [0.4] * 3
    kept = quality_filter(df, model)
    assert kept.columns == df.columns and kept.count() == 3
    assert quality_filter(df, {"constant": 0.2}).count() == 0


def brute_lines(rows, width=5):
    seen, kept = [], {}
    for i, k, line in sorted((i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n"))):
        w = [x for x in line.replace("\t", " ").replace("\r", " ").split(" ") if x]
        if not w:
            continue
        s = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))}
        if not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
            kept.setdefault(i, []).append(k)
        seen.append(s)
    return kept


def line_rows():
    random.seed(12)
    vocabulary = ["w%d" % k for k in range(400)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(1, 70))] for _ in range(120)]
    lines = list(base)
    for b in base[:80]:
        c = list(b)
        c[random.randrange(len(c))] = "edit"
        lines += [c, b, [*b, "tail"], b[1:] or ["x"]]
    for _ in range(60):  # many near copies of one line
        c = list(base[0] * 3)
        c[random.randrange(len(c))] = random.choice(vocabulary)
        lines.append(c)
    random.shuffle(lines)
    docs = [(k, "\n".join(random.choice((" ", "  ", "\t")).join(x) for x in lines[4 * k : 4 * k + 4])) for k in range(len(lines) // 4)]
    return docs + [(1000, None), (1001, ""), (1002, "\n \n"), (1003, "end\n\nend\r"), (1004, "long word " * 20_000)]


def test_lines_match_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, no int")
    got = {r["id"]: r["kept"] for r in kept_lines(df).collect()}
    assert got == brute_lines(rows)


def test_lines_that_keep_half_of_their_tokens(spark, monkeypatch):
    """Also where every line is a long one and many are read again as a whole."""
    from sparkloom.llm import line_dedup

    random.seed(5)
    passage = ["p%d" % k for k in range(45)]
    rows = line_rows() + [(2000 + k, " ".join(passage + ["o%d" % random.randrange(10**6) for _ in range(k % 14)])) for k in range(60)]
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_lines(rows)
    for short in (line_dedup.SHORT, 0):
        monkeypatch.setattr(line_dedup, "SHORT", short)
        assert {r["id"]: r["kept"] for r in kept_lines(df).collect()} == want


def test_lines_of_null_and_repeated_ids(spark):
    run = " ".join("w%d" % k for k in range(40))
    rows = [
        (None, f"{run}\nfirst null line"), (None, f"second null line\n{run} tail"), (None, f"{run} end\nthird null line"),
        (3, f"{run} more\nonly three"), (3, f"other three\n{run}"), (3, f"other three\n{run}"), (4, "first null line\nlast"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # of the near copies the first by id, line number and hash of the text stays
    out = sorted((str(r["doc_id"]), r["text"]) for r in dedup_lines(df).collect())
    nulls = [t for i, t in out if i == "None"]
    assert sorted(x for t in nulls for x in t.split("\n") if not x.startswith(run)) == ["first null line", "second null line", "third null line"]
    assert sum(run in t for t in nulls) == 1
    assert [x for x in out if x[0] != "None"] == [("3", "only three"), ("3", "other three"), ("3", "other three"), ("4", "last")]


def test_dedup_lines_cuts_texts(spark):
    rows = [(1, "same words here\n\nonly one", "c"), (2, "same words here\nonly two", "c"), (3, "same  words here", "c"), (4, None, "c"), (5, "", "c"), (None, "fresh start", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = dedup_lines(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "same words here\n\nonly one", 2: "only two", 4: None, 5: "", None: "fresh start"}
    assert dedup_lines(df.limit(0)).collect() == []


def test_shuffled_lookup_gives_the_same(spark, monkeypatch):
    from sparkloom.llm import line_dedup

    df = spark.createDataFrame(line_rows(), "doc_id long, text string")
    want = sorted(dedup_lines(df).collect(), key=str)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(dedup_lines(df).collect(), key=str) == want


def test_no_shuffle_files_stay_behind_a_table(spark):
    import time

    from sparkloom.llm.common import SHUFFLES_GO, stage

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in str(disk.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    old, setting = files(), spark.conf.get(SHUFFLES_GO, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert stage(df, "grouped").count() == 7
    until = time.time() + 20
    # the count's own file goes when Spark collects it
    while len(files() - old) > 8 and time.time() < until:
        time.sleep(0.2)
    tables = [stage(df, "grouped") for _ in range(5)]
    until = time.time() + 20
    while len(files() - old) > 8 and time.time() < until:
        time.sleep(0.2)
    assert len(tables) == 5 and len(files() - old) <= 8
    assert spark.conf.get(SHUFFLES_GO, None) == setting


def test_text_hashes_go_along_only_where_ids_repeat(spark):
    from sparkloom.llm.line_dedup import ids_repeat

    df = spark.createDataFrame([(1, "a b c\nd e f"), (2, "a b c"), (None, "g")], "doc_id long, text string")
    assert not ids_repeat(df) and not ids_repeat(df.limit(0)) and ids_repeat(df.union(df.where("doc_id is null")))
    assert {r["h"] for r in kept_lines(df).collect()} == {0}
    assert 0 not in {r["h"] for r in kept_lines(df.union(df)).collect()}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sizes, df = [docs.count()], docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        df = step(spark, df, SF)
        assert df.columns == docs.columns
        df = spark.createDataFrame(df.toPandas(), docs.schema)
        sizes.append(df.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    ids = {r["doc_id"] for r in df.collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(ids & bad) <= 0.05 * len(bad)
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
