"""Packing along a space-filling curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from . import tokens
from .common import stage, text_or_empty

BUCKETS, DIMS, BITS = 256, 4, 12
TOKENS_A_PARTITION = 4_000_000
#: Most tokens of a document in one row between the stages.
CHUNK = 1 << 15


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of ``cells`` (coordinates below
    2**bits), by Skilling's transform."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for k in range(dims):
            hit = (x[:, k] & q) != 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, k]) & (q - 1))
            x[:, 0] ^= np.where(hit, q - 1, swap)
            x[:, k] ^= swap if k else 0
        q >>= 1
    for k in range(1, dims):
        x[:, k] ^= x[:, k - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(dims):
            key = key << 1 | (x[:, k] >> bit & 1)
    return key


def document_cell(ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The grid cell of a document: its token counts, hashed into BUCKETS and
    scaled to length 1, projected on DIMS directions, each mapped to a grid so
    that random vectors fill it evenly."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    v = np.sqrt(np.bincount(hashed, minlength=BUCKETS).astype(np.float64))
    v /= max(np.linalg.norm(v), 1e-9)
    spread = 1 / (1 + np.exp(-1.702 * 3 * (v @ directions)))
    return np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def _tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    directions = np.random.default_rng(5).normal(size=(BUCKETS, DIMS))
    directions -= directions.mean(axis=0)

    def run(batches):
        model = tokens.load(path)
        kind = "<u2" if max(model.n_vocab, end_id) <= 1 << 16 else "<u4"
        salt = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.append(tokens.encode(model, t), np.uint32(end_id)) for t in part.column(1).to_pylist()]
                key = hilbert_key(np.stack([document_cell(x, directions) for x in ids]))
                tie = salt.integers(0, 1 << 62, len(ids))
                cuts = [(k, s) for k, x in enumerate(ids) for s in range(0, len(x), CHUNK)]
                row = pa.array([k for k, _ in cuts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), pa.array(key).take(row), pa.array(tie).take(row), pa.array([len(x) for x in ids], pa.int64()).take(row),
                     pa.array([s for _, s in cuts], pa.int64()), pa.array([ids[k][s : s + CHUNK].astype(kind).tobytes() for k, s in cuts], pa.binary())],
                    names=["id", "key", "tie", "n", "start", "ids"],
                )

    narrow = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(docs, text_col).alias("t"))
    return narrow.mapInArrow(run, "id long, key long, tie long, n long, start long, ids binary")


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens:
    (doc_id, start, length, ids, doc_tokens, sequence_id, offset), ids as
    little-endian unsigned 32-bit binary.

    Documents are range-sorted by their Hilbert key, so that neighbours on the
    curve share sequences, and laid end to end within each range; every
    sequence is full but the last of each range. Rows of one key are ordered by
    a number drawn for each document when it is tokenised, so that copies spread
    over several ranges even if they share their id, and long documents move in
    rows of CHUNK tokens. Ranges hold some millions of tokens, so that what the
    last sequences leave open stays far below one per cent. Sequence ids are
    unique, not consecutive. Lost tasks are repeated from the staged table of
    token ids, which also holds the drawn numbers.

    Null text counts as empty; an empty document is its end id alone. Repeated
    rows and ids are packed each; rows with null ids are packed too; other
    columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    coded = stage(_tokenised(docs, path or tokens.default_path(), id_col, text_col, end_id), "tokens")
    total = coded.where("start = 0").agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // TOKENS_A_PARTITION))
    dealt = coded.repartitionByRange(ranges, "key", "tie", "start")

    def run(batches):
        at, sequence = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for doc, n, begin, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                here = min(CHUNK, n - begin)
                ids = np.frombuffer(ids, f"<u{len(ids) // here}").astype("<u4").tobytes()
                start = 0
                while start < here:
                    if at == length:
                        at, sequence = 0, sequence + 1
                    size = min(here - start, length - at)
                    rows.append((doc, begin + start, size, ids[4 * start : 4 * (start + size)], n, sequence, at))
                    start, at = start + size, at + size
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields
                )

    kinds = {"doc_id": "int64", "start": "int64", "length": "int64", "ids": "binary", "doc_tokens": "int64",
             "sequence_id": "int64", "offset": "int64"}
    fields = pa.schema([(k, getattr(pa, v)()) for k, v in kinds.items()])
    ordered = dealt.sortWithinPartitions("key", "tie", "start").select("id", "n", "start", "ids")
    return ordered.mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
