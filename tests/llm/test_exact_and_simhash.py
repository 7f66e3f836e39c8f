import hashlib
import random
import re

import numpy as np
import xxhash

from sparkloom.llm.components import connected_components
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.simhash import _Groups, across, compare_blocks, joining, propose, simhash_dedup, simhash_groups

DOCS = "doc_id long, text string, source string, keep_id string, d string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "clash", "clash") for r in rows], DOCS)


def brute_exact(rows):
    norm = [(i, re.sub("[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        ids = [k for k, u in norm if u == t]
        low = min((k for k in ids if k is not None), default=None)
        out.append((i, low, len(ids), i == low, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (3, ""), (7, "ü" * 50_000), (4, "ü" * 50_000), (8, "a b"), (6, " "), (None, "a b"), (None, "only"), (2, "a b")]
    rows += [(k, "copy") for k in range(100, 400)]
    got = [tuple(r) for r in exact_dedup(docs(spark, rows), runs=16, fan_in=4).collect()]
    assert sorted(got, key=str) == brute_exact(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(docs(spark, [])).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def print_of(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(rows, width, radius):
    prints = [print_of(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    low = {x: min((r[0] for r, y in zip(rows, label, strict=True) if x == y and r[0] is not None), default=None) for x in label}
    return sorted(((r[0], f"{p:016x}", low[x]) for r, p, x in zip(rows, prints, label, strict=True)), key=str)


def texts():
    random.seed(5)
    words = ["w%d" % k for k in range(60)] + ["Ünï", "A-b", "日本"]
    base = [" ".join(random.choice(words) for _ in range(80)) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + k, t.upper().lower().replace("w1 ", "W1  ")) for k, t in enumerate(base[:10])]
    rows += [(200 + k, t + " w3") for k, t in enumerate(base)]
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "ONE two"), (None, "one  two"), (305, "x " * 40_000)]


def test_simhash_matches_brute_force(spark):
    rows = texts()
    got = simhash_groups(docs(spark, rows), width=3, radius=4).collect()
    assert sorted(((r["id"], f"{r['fp'][0] & (1 << 64) - 1:016x}", r["component"]) for r in got), key=str) == groups_of(rows, 3, 4)
    assert simhash_groups(docs(spark, [])).collect() == []


def test_tiles_lose_no_link():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, (3000, 1), np.uint64)
    fp[2000:, 0] = fp[:1000, 0] ^ (np.uint64(1) << rng.integers(0, 63, 1000).astype(np.uint64))
    label = compare_blocks(fp, fp, 2, True)
    assert (label[2000:] == np.arange(1000)).all()
    both = compare_blocks(fp[:2000], fp[2000:], 2, False)
    assert (both[2000:] == np.arange(1000)).all()


def test_simhash_dedup_keeps_one_of_each_group(spark):
    random.seed(8)
    base = [" ".join("w%d" % random.randrange(5000) for _ in range(300)) for _ in range(40)]
    near = [t.replace(t.split()[7], "changed", 1) for t in base]
    rows = [(2 * k, t) for k, t in enumerate(base)] + [(1001 + k, t) for k, t in enumerate(near)] + [(None, "alone here")]
    kept = simhash_dedup(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "keep_id", "d"]
    assert {r["doc_id"] for r in kept.collect()} == {2 * k for k in range(40)} | {None}


def test_simhash_dedup_decides_by_jaccard(spark):
    """Ten pairs each at Jaccard 0.6, 0.75, 0.8 and 0.85: copies go from 0.8 on."""
    rows, want = [], set()
    for k, shared in enumerate([102] * 10 + [117] * 10 + [121] * 10 + [126] * 10):  # of 136 shingles each
        random.seed(k)
        words = [f"v{k}x{j}" for j in range(140)]
        other = words[: shared + 4] + [f"u{k}x{j}" for j in range(136 - shared)]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(other))]
        want |= {k} if shared / (272 - shared) >= 0.8 else {k, 1000 + k}
    assert {r["doc_id"] for r in simhash_dedup(docs(spark, rows)).collect()} == want


def test_further_bits_rule_out_chance_pairs():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 64, (600, 4), dtype=np.uint64)
    fp[300:, :2] = fp[:300, :2] ^ np.uint64(1)  # by the first words all 300 are near
    fp[450:, 2:] = fp[150:300, 2:] ^ np.uint64(0xFF)  # by the further ones only these
    got = {tuple(sorted(x)) for x in propose(fp, fp, 36, True, None).tolist()}
    assert {(k, k + 300) for k in range(150, 300)} <= got and len(got) < 160
    assert len(propose(fp[:, :2].copy(), fp[:, :2].copy(), 36, True, None)) >= 300


def test_links_between_parts_are_all_proposed():
    rng = np.random.default_rng(3)
    fp = np.repeat(rng.integers(0, 1 << 63, (40, 2), np.uint64), 5, axis=0)
    fp[:, 0] ^= np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= 4
    part = np.arange(200) % 3
    want = {(a, b) for a in range(200) for b in range(a) if near[a, b] and part[a] != part[b]}
    assert {(max(x), min(x)) for x in propose(fp, fp, 4, True, part).tolist()} == want
    forest = propose(fp, fp, 4, True, None)
    assert len(forest) == 160 and all(near[a, b] for a, b in forest)


def test_simhash_dedup_of_an_id_that_stays_and_goes(spark):
    random.seed(9)
    a, b = (" ".join("w%d" % random.randrange(5000) for _ in range(300)) for _ in range(2))
    rows = [(1, a), (7, a + " tail"), (7, b), (9, b + " tail"), (None, a), (None, b)]
    got = [(r["doc_id"], r["text"]) for r in simhash_dedup(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (7, b), (None, a), (None, b)], key=str)


def test_links_that_join_parts():
    """Those that are found join the parts as all links of near and similar rows would."""
    rng = np.random.default_rng(11)
    fp = rng.integers(0, 2**63, (90, 1)).astype(np.uint64)
    fp = np.concatenate((fp, fp[:60] ^ np.uint64(5), fp[:30] ^ np.uint64(9), fp[:20]))
    part = np.arange(len(fp)) // 2 * 7
    sets = [np.unique(rng.integers(k % 90 * 10, k % 90 * 10 + 12, 11)) for k in range(len(fp))]
    sets[0] = sets[90] = np.zeros(0, np.int64)
    near = [(i, j) for i in range(len(fp)) for j in range(i) if bin(int(fp[i, 0] ^ fp[j, 0])).count("1") <= 4 and part[i] != part[j]]
    alike = [(i, j) for i, j in near if 5 * len(both := np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) or 0 * len(both)]
    assert len(alike) not in (0, len(near))

    def grouped(links):
        groups = _Groups(len(fp))
        of = np.unique(part, return_index=True, return_inverse=True)
        groups.label = of[1][of[2]]
        for i, j in links:
            groups.link(np.array([i]), np.array([j]))
        return groups.label.tolist()

    for cut in (0, 70):
        left, right = (fp[:cut] if cut else fp), fp[cut:]
        inside = [(i, j) for i, j in alike if not cut or (i >= cut) != (j >= cut)]
        found = joining(left, right, 4, not cut, part, sets)
        assert grouped(found) == grouped(inside) and {(max(x), min(x)) for x in found.tolist()} <= set(inside)
        assert across(left, right, 4, not cut, part).tolist() == sorted({k for i, j in near if not cut or (i >= cut) != (j >= cut) for k in (i, j)})
