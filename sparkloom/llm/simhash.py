"""SimHash near-dedup: tiled exact comparison of fingerprints with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from .common import scratch, stage, text_or_empty
from .components import connected_components
from .secrets import KEY, _row_key

SEED = 42
ROWS_A_BLOCK = 1 << 18
#: The same where rows come with the shingles of their texts.
ROWS_WITH_SETS = 1 << 11
TILE = 256
#: Links that a group of work gathers before it reduces them to a spanning forest.
LINKS = 1 << 20
#: Least Jaccard similarity of near copies, as a fraction.
NUM, DEN = 4, 5
#: Bits of the further words by which near copies may differ, of 128. Unrelated texts pass by one pair in 300.
FURTHER = 48
#: Rows up to which a table of keys is broadcast; a larger one is joined by shuffles.
BROADCAST_KEYS = 1_000_000


def _digests(text: str, width: int, words: int) -> list[bytes]:
    """Hashes of the ``width``-word shingles of ``text``, in order."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return []
    flat, k = b" ".join(parts), min(width, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = (xxhash.xxh64_digest, xxhash.xxh3_128_digest)[words - 1]
    return [digest(flat[s:e], SEED) for s, e in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def fingerprint(text: str, width: int, words: int = 1, distinct: bool = False) -> list[int]:
    """SimHash of the ``width``-word shingles of ``text``, or of the distinct ones,
    as one or two signed 64-bit words: by XXH64, or by XXH3 with 128 bits. Four
    words are those two and two further ones by the same digests, mixed."""
    cut = _digests(text, width, min(words, 2))
    if not cut:
        return [0] * words
    cut = list(dict.fromkeys(cut)) if distinct else cut
    h = np.frombuffer(b"".join(cut), np.uint8).reshape(len(cut), -1)
    if words > 2:
        h = np.concatenate((h, _mixed(h.view(np.uint64)).view(np.uint8)), axis=1)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(">i8").tolist()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Further bits of 64-bit hashes, by the finalizer of SplitMix64."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """(id, k1, k2, fp array<long>) per row, with the two hashes of id and text: ASCII letters in lower case, words parted by
    ASCII white space, shingles hashed by XXH64 for one
    word, by XXH3 for two or four; a bit is 1 if over half of the
    hashes, or of the distinct ones, have it. Shorter texts are one shingle, texts without words give 0."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, width, words, distinct) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["id", *KEY, "fp"]
            )

    ship(docs.sparkSession)
    text = text_or_empty(docs, text_col)
    keys = (k.alias(n) for k, n in zip(_row_key(docs[id_col], text), KEY, strict=True))
    return docs.select(docs[id_col].cast("long").alias("id"), *keys, text.alias("t")).mapInArrow(run, "id long, k1 long, k2 long, fp array<long>")


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of every 16-bit quarter of the first two words: rows by quarters."""
    fp = np.ascontiguousarray(fp[:, :2])
    return np.bitwise_count(fp.view(np.uint16).reshape(len(fp), -1)).astype(np.int16)


class _Groups:
    """Smallest-label groups of 0..n-1, fed with arrays of links."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            root = np.arange(len(self.label))
            np.minimum.at(root, high, low)
            while not np.array_equal(root, up := root[root]):
                root = up
            self.label = root[self.label]


def _near(left: np.ndarray, right: np.ndarray, radius: int, same: bool):
    """Rows of left, rows of right and distances of all pairs within ``radius``
    bits, tile by tile; with ``same``, a pair may come in both orders. Words beyond
    the second are no part of the distance: a pair goes if they differ by more than
    FURTHER bits.

    Both sides are sorted by the population counts of their 16-bit quarters and
    cut into tiles. The quarters' counts of two fingerprints differ by at most
    their distance in sum, so a pair of tiles whose ranges of counts are further
    apart than the radius is skipped.
    """
    def tiles(fp):
        c = _counts(fp)
        order = np.lexsort(c.T[::-1])
        c, cuts = c[order], np.arange(0, len(fp), TILE)
        low = np.minimum.reduceat(c, cuts, axis=0)
        return order, fp[order], cuts, low, np.maximum.reduceat(c, cuts, axis=0)

    lo, lf, lc, llow, lhigh = tiles(left)
    ro, rf, rc, rlow, rhigh = (lo, lf, lc, llow, lhigh) if same else tiles(right)
    for i, at in enumerate(lc):
        a = lf[at : at + TILE]
        gap = np.maximum(0, np.maximum(rlow - lhigh[i], llow[i] - rhigh)).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            b = rf[rc[j] : rc[j] + TILE]
            d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            for w in range(1, min(2, a.shape[1])):
                d = d + np.bitwise_count(a[:, None, w] ^ b[None, :, w])
            near = d <= radius
            if near.any():
                x, y = np.nonzero(near)
                if a.shape[1] > 2:
                    use = np.bitwise_count(a[x, 2:] ^ b[y, 2:]).sum(axis=1) <= FURTHER
                    x, y = x[use], y[use]
                yield lo[at + x], ro[rc[j] + y], d[x, y]


def compare_blocks(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Group label of each row of left followed by right (the same array if
    ``same``), by the links between left and right at ``radius`` bits or fewer."""
    groups = _Groups(len(left) if same else len(left) + len(right))
    base = 0 if same else len(left)
    for x, y, _ in _near(left, right, radius, same):
        groups.link(x, y + base)
    return groups.label


def _forest(n: int, links: np.ndarray) -> np.ndarray:
    """The rows (x, y, distance) of ``links`` in a spanning forest of least distances."""
    links = links[np.argsort(links[:, 2], kind="stable")]
    groups, taken, live = _Groups(n), np.zeros(len(links), bool), np.arange(len(links))
    while True:
        a, b = groups.label[links[live, 0]], groups.label[links[live, 1]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            return links[taken]
        best = np.full(n, len(links))
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        pick = np.unique(best[best < len(links)])
        taken[pick] = True
        groups.link(links[pick, 0], links[pick, 1])


def propose(left: np.ndarray, right: np.ndarray, radius: int, same: bool, part: np.ndarray | None) -> np.ndarray:
    """Links (x, y) between rows of left followed by right (the same array if
    ``same``) within ``radius`` bits: a spanning forest of the least distances,
    or, if ``part`` names a part for each row, all those between two parts."""
    n, base = (len(left), 0) if same else (len(left) + len(right), len(left))
    held, size = [np.empty((0, 3), np.int64)], 0
    for x, y, d in _near(left, right, radius, same):
        y = y + base
        use = x != y if part is None else part[x] != part[y]
        new = np.stack((x[use], y[use], d[use].astype(np.int64)), axis=1)
        held.append(new)
        size += len(new)
        if part is None and size > LINKS:
            held = [_forest(n, np.concatenate(held))]
            size = len(held[0])
    links = np.concatenate(held)
    return (_forest(n, links) if part is None else links)[:, :2]


def across(left: np.ndarray, right: np.ndarray, radius: int, same: bool, part: np.ndarray) -> np.ndarray:
    """The rows of left followed by right (the same array if ``same``) that are within
    ``radius`` bits of a row of another part. Holds one flag for each row."""
    base = 0 if same else len(left)
    found = np.zeros(len(left) + (0 if same else len(right)), bool)
    for x, y, _ in _near(left, right, radius, same):
        use = part[x] != part[y + base]
        found[x[use]] = True
        found[y[use] + base] = True
    return np.flatnonzero(found)


def joining(left: np.ndarray, right: np.ndarray, radius: int, same: bool, part: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Links (x, y), within ``radius`` bits and of sorted sets with a Jaccard similarity
    of NUM/DEN, that join the parts as all such links would. A pair whose parts are
    joined already is not looked at, so there are fewer links than rows."""
    base = 0 if same else len(left)
    _, first, of = np.unique(part, return_index=True, return_inverse=True)
    groups, size, out = _Groups(len(part)), np.array([len(s) for s in sets], np.int64), []
    groups.label = first[of]
    for x, y, _ in _near(left, right, radius, same):
        y = y + base
        while len(x):
            low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            use = (groups.label[x] != groups.label[y]) & (DEN * low >= NUM * high)
            x, y = x[use], y[use]
            for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                a, b = (sets[i], sets[j]) if size[i] < size[j] else (sets[j], sets[i])
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
                if DEN * both >= NUM * (len(a) + len(b) - both):
                    out.append((i, j))
                    groups.link(np.array([i]), np.array([j]))
                    x, y = x[k + 1 :], y[k + 1 :]
                    break
            else:
                break
    return np.array(out, np.int64).reshape(-1, 2)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = 3, words: int = 1, radius: int = 2) -> DataFrame:
    """(id, fp, component) per row of ``docs``: component is the smallest id
    reachable over links of ``radius`` differing bits or fewer.

    Equal fingerprints are one node, so copies cost nothing further. The nodes
    fall into g blocks by hash, and each pair of blocks is one group of work:
    blocks are even whatever the texts are, and a node is sent to g groups. g
    grows with the root of the number of nodes, which holds a group's memory
    to about two blocks of ROWS_A_BLOCK. A pair of blocks returns a spanning
    set of links, never all pairs. The number of comparisons grows with the
    square of the nodes, less the tiles that counts rule out.

    Null text counts as empty; all empty texts have fingerprint 0 and are linked
    like others. Rows with the same id are separate rows of the same text class
    only if their fingerprints link. A null id is never the smallest unless all
    ids of the component are null. No rows give no rows.
    """
    prints = stage(fingerprints(docs, id_col, text_col, width, words), "fingerprints")
    nodes = stage(_nodes(prints), "nodes")

    def run(fp, key, cut, part, sets):
        label = compare_blocks(fp[:cut], fp[cut:], radius, False) if cut else compare_blocks(fp, fp, radius, True)
        to = np.flatnonzero(label != np.arange(len(label)))
        return key[to], key[label[to]]

    return _named(prints, nodes, connected_components(_links(nodes, run))).select("id", "fp", "component")


def _nodes(prints: DataFrame) -> DataFrame:
    """(fp, low, row, key) of each distinct fingerprint: smallest id, keys of one row, hash."""
    return prints.groupBy("fp").agg(F.min("id").alias("low"), F.min(F.struct(*KEY)).alias("row"), F.min(F.xxhash64("fp")).alias("key"))


def _links(nodes: DataFrame, find, rows: int = ROWS_A_BLOCK) -> DataFrame:
    """(src, dst) that ``find`` returns for each pair of blocks, from fingerprints,
    keys, the row at which the second block begins (0 for a block with itself),
    and parts and sets, where ``nodes`` has the columns ``part`` and ``s``."""
    blocks = 8 * max(1, int(np.ceil(np.sqrt(nodes.count() / 8 / rows))))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    block = F.pmod(F.col("key"), F.lit(blocks)).cast("int")
    more = [c for c in ("part", "s") if c in nodes.columns]
    dealt = nodes.select("fp", "key", *more, block.alias("block"), F.explode(every).alias("other")).select(
        "fp", "key", *more, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        if i != j:
            pdf = pdf.sort_values("block", kind="stable")
        cut = int((pdf["block"] == i).sum()) if i != j else 0
        if i != j and cut in (0, len(pdf)):
            return pd.DataFrame({"src": [], "dst": []})
        fp = np.array(pdf["fp"].tolist(), np.int64).view(np.uint64).reshape(len(pdf), -1)
        part, sets = (pdf["part"].to_numpy() if "part" in more else None), (pdf["s"].tolist() if "s" in more else None)
        src, dst = find(fp, pdf["key"].to_numpy(), cut, part, sets)
        return pd.DataFrame({"src": src, "dst": dst})

    return dealt.groupBy("i", "j").applyInPandas(run, "src long, dst long")


def _named(prints: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, k1, k2, fp, component) per row of ``prints``, by the components of the nodes' keys."""
    labelled = nodes.join(linked, nodes["key"] == linked["node"], "left").select(
        "fp", "low", F.coalesce("component", "key").alias("label")
    )
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component"))
    named = labelled.join(lowest, "label").select("fp", "component")
    return prints.join(named, "fp").select("id", *KEY, "fp", "component")


def _shingles(put, ends: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(key, s) of the nodes that ``ends`` (key) names: the sorted hashes of their
    distinct shingles. Texts are read again for these nodes only."""
    rows = put(nodes.join(ends, "key", "left_semi").select("key", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2")), "ends")
    few = rows.count() <= BROADCAST_KEYS
    text = text_or_empty(docs, text_col)
    texts = docs.select(*(k.alias(n) for k, n in zip(_row_key(docs[id_col], text), KEY, strict=True)), text.alias("t"))
    texts = texts.join(F.broadcast(rows) if few else rows, KEY).select("key", "t").dropDuplicates(["key"])

    def run(batches):
        for batch in batches:
            sets = [np.unique(np.frombuffer(b"".join(_digests(t, width, 1)), ">i8").astype(np.int64)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "s"])

    return put(texts.mapInArrow(run, "key long, s array<long>"), "shingles")


def _verified(put, links: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The links whose texts share NUM/DEN of their distinct shingles."""
    links = put(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links")
    ends = links.select(F.col("src").alias("key")).union(links.select("dst")).distinct()
    sets = _shingles(put, ends, nodes, docs, id_col, text_col, width)
    a, b = sets.select(F.col("key").alias("src"), F.col("s").alias("a")), sets.select(F.col("key").alias("dst"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    met = links.join(a, "src").join(b, "dst").where(DEN * both >= NUM * (F.size("a") + F.size("b") - both))
    return put(met.select("src", "dst"), "verified")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = 5, words: int = 2, radius: int = 36) -> DataFrame:
    """(id, k1, k2, fp, component) per row of ``docs``: component is the smallest
    id reachable over pairs of texts whose sets of ``width``-word shingles have a
    Jaccard similarity of NUM/DEN or more.

    Fingerprints of the distinct shingles propose the pairs, the sets decide.
    Two texts of equal size at 0.8 differ in 19 of 128 bits on average, and in
    more than 36 for about one pair in 20,000; unequal sizes differ less. Of
    texts with 5 shingles, 4 of them shared, about one in 300 pairs is missed.
    Unrelated texts are within 36 bits for six pairs in ten million, which grow
    with the square of the documents; of these, 128 further bits rule out all but
    one in 300 before any set is sent. Near copies lie at least five standard
    deviations within that bound.

    First each pair of blocks proposes a spanning forest of its least distances,
    so that a large group of near copies costs few links. Of the texts that the
    verified links have not joined though they are within the radius, the sets then
    go along with the fingerprints, and a pair of blocks verifies in its own task
    whatever pairs still lie in two parts: no task returns more than a link for each
    row. Equal fingerprints are one node and are not compared.
    """
    with scratch(docs.sparkSession) as put:
        prints = put(fingerprints(docs, id_col, text_col, width, 4 if words == 2 else words, True), "fingerprints")
        nodes = put(_nodes(prints), "nodes")

        def run(fp, key, cut, part, sets):
            links = propose(fp[:cut] if cut else fp, fp[cut:], radius, not cut, part)
            return key[links[:, 0]], key[links[:, 1]]

        def waiting(fp, key, cut, part, sets):
            at = across(fp[:cut] if cut else fp, fp[cut:], radius, not cut, part)
            return key[at], key[at]

        def verify(fp, key, cut, part, sets):
            links = joining(fp[:cut] if cut else fp, fp[cut:], radius, not cut, part, sets)
            return key[links[:, 0]], key[links[:, 1]]

        first = _verified(put, _links(nodes, run), nodes, docs, id_col, text_col, width)
        joined = connected_components(first)
        parted = nodes.join(joined, nodes["key"] == joined["node"], "left").select("fp", "row", "key", F.coalesce("component", "key").alias("part"))
        parted = put(parted, "parted")
        open_ = put(_links(parted, waiting).select(F.col("src").alias("key")).distinct(), "open")
        sets = _shingles(put, open_, nodes, docs, id_col, text_col, width)
        rest = put(_links(put(parted.join(sets, "key").select("fp", "key", "part", "s"), "open-sets"), verify, ROWS_WITH_SETS), "joined")
        return stage(_named(prints, nodes, connected_components(first.union(rest))), "near-copies")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  width: int = 5, words: int = 2, radius: int = 36) -> DataFrame:
    """``docs`` without the rows that are near copies of a row with a smaller id,
    directly or over other rows, as ``near_copies`` finds them.

    Rows are told apart by id and text: of an id with several texts, each row
    goes or stays by its own group. Rows with null ids and further rows with the
    id that stands for their group are kept, so exact repetitions of a row go or
    stay together. Null and empty texts have no words and are copies of each
    other: of them the one with the smallest id stays. Other columns are returned
    unchanged, whatever their names; no rows give no rows.
    """
    groups = near_copies(docs, id_col, text_col, width, words, radius)
    gone = stage(groups.where("id <> component").select(*KEY).distinct(), "gone")
    few = gone.count() <= BROADCAST_KEYS
    keys = (k.alias(n) for k, n in zip(_row_key(docs[id_col], text_or_empty(docs, text_col)), KEY, strict=True))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *keys).join(F.broadcast(gone) if few else gone, KEY, "left_anti")
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
