"""Whitening of embeddings by their leading principal components.

The covariance matrix is never formed. A block Lanczos iteration on the driver
asks Spark for products of it with a few columns; each is one pass over the
distinct vectors, in which a task centres its rows, multiplies twice and returns
one partial sum for each dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Columns that one pass multiplies, and columns kept before the basis is cut down to its best ones.
BLOCK, BASIS = 16, 256
EPS = float(np.finfo(np.float64).eps)
_LONG = 2**63


@dataclass(frozen=True)
class Fit:
    """``sums``: per dimension; ``values``: falling; ``components``: a column each."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def grid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): x is floor(256 c) of each entry, as long. Rows whose vector is null
    or holds null or non-finite entries are left out; null and repeated ids stay."""
    v = vectors[vector_col].cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(256.0) * c).cast("long"))
    return vectors.where(v.isNotNull() & fine).select(vectors[id_col].alias("id"), x.alias("x"))


def _padded(rows: DataFrame, width: int) -> DataFrame:
    """Vectors shorter than the longest get zeros at their end."""
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _summed(fit: DataFrame, width: int, out: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part``, a function of a batch's vectors that
    returns an array of ``out`` columns. A task adds up its own batches; Spark adds
    up the tasks' rows by their number, so only the sum comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = part(_matrix(b.column(0), width))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, total.T.copy())], ["row", *names])

    names = [f"v{k}" for k in range(out)]
    partial = fit.select("x").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in names))
    rows = partial.groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).collect()
    return np.array([tuple(r)[1:] for r in sorted(rows)], np.float64)


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Columns of ``block`` made orthogonal to ``basis`` (twice, for rounding) and to
    each other. Where a column is lost in that, a random one takes its place, as
    the Krylov space has broken down there while others may be left."""
    block = block[:, : basis.shape[0] - basis.shape[1]]
    out = basis
    for column in block.T:
        for attempt in range(5):
            scale = np.linalg.norm(column)
            for _ in range(2):
                column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if scale > 0 and size > 1e-10 * scale:
                column = column / size
                column = column - out @ (out.T @ column)
                out = np.column_stack((out, column / np.linalg.norm(column)))
                break
            column = rng.normal(size=column.shape)
    return out[:, basis.shape[1] :]


def lanczos(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int = BLOCK, basis: int = BASIS, most: int = 300) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, passes): the ``wanted`` largest eigenvalues of a symmetric
    matrix that is known by its products only. Every new block is orthogonalised
    against the whole basis. It ends once the residuals of all wanted pairs are as
    small as rounding allows, once they stop falling there, or once the basis spans
    the space; a basis of more than ``basis`` columns is cut down to its best."""
    rng = np.random.default_rng(13)
    q, w = np.zeros((width, 0)), np.zeros((width, 0))
    fresh, last, passes = rng.normal(size=(width, min(block, width))), np.inf, 0
    while True:
        fresh = _orthonormal(fresh, q, rng)
        got = times(fresh)
        q, w, passes = np.column_stack((q, fresh)), np.column_stack((w, got)), passes + 1
        t = q.T @ w
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        k = min(wanted, len(values))
        left = np.linalg.norm(w @ y[:, :k] - (q @ y[:, :k]) * values[:k], axis=0).max() / max(abs(values[0]), np.finfo(float).tiny)
        done = k == wanted and (left <= 8 * EPS or (left <= 1e-12 and left > last / 2))
        if done or q.shape[1] >= width or passes >= most:
            return values[:k], q @ y[:, :k], passes
        last = left
        fresh = got - q @ (q.T @ got)
        if q.shape[1] + block > basis:
            keep = min(wanted + block, len(values))
            q, w = q @ y[:, :keep], w @ y[:, :keep]


def fit_whitening(fit: DataFrame, width: int, wanted: int = 4) -> Fit | None:
    """Fit on ``fit``, whose x vectors are distinct and of ``width`` entries. The
    sums are exact. None without rows, without entries or where all rows are equal."""
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not sums:
        return None
    n, sums = sums[0]["n"], tuple(int(r["s"]) for r in sorted(sums))
    mean = np.array([s / n for s in sums])

    def spread(x: np.ndarray) -> np.ndarray:
        return np.array([[np.square(deviations(x, n, sums)[1]).sum() / n / n]])

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ columns)

        return _summed(fit, width, columns.shape[1], part) / n

    trace = float(_summed(fit, width, 1, spread)[0, 0]) / n
    if not trace > 0:
        return None
    values, vectors, passes = lanczos(product, width, min(wanted, width))
    real = values > 16 * width * EPS * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    scaled = vectors / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ scaled
        return np.vstack((z.T @ z, z.sum(0)))

    m = _summed(fit, width, k, moments) / n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())
    return Fit(n, sums, values, vectors, trace, error, passes + 3)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[list[int | None], np.ndarray]:
    """Of each row the sum of (n x - S)^2, None where no long holds it, and n x - S
    in double. Integer arithmetic of 64 bits wraps around, so the sum is right
    whenever it fits; the double next to it tells that. Terms that may not fit
    themselves, and sums close to the limit, are added up in Python's integers."""
    rough = x.astype(np.float64) * n
    if rough.size and max(float(np.abs(rough).max()), float(max(map(abs, sums)))) >= 2.0**61:
        exact = [[n * int(v) - s for v, s in zip(row, sums, strict=True)] for row in x]
        total = [sum(v * v for v in row) for row in exact]
        return [t if t < _LONG else None for t in total], np.array(exact, np.float64).reshape(x.shape)
    d = x * n - np.array(sums, np.int64)
    out = (d * d).sum(1).tolist()
    about = np.square(d.astype(np.float64)).sum(1)
    for k in np.flatnonzero(about > 0.999 * _LONG):
        t = sum(int(v) ** 2 for v in d[k])
        out[k] = t if t < _LONG else None
    return out, d.astype(np.float64)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = 4) -> DataFrame:
    """(id, component int, n, deviation long, whitened, explained, identity_error double)
    for each usable row and each of up to ``wanted`` components.

    The fit counts each distinct x vector once, the result has a row for every
    usable one, null and repeated ids and repeated rows included. Vectors that are
    null or hold null or non-finite entries are left out; shorter ones are filled
    up with zeros; entries beyond a long's range are cut to it. Components without
    variance are not returned, so an empty table, a single vector or equal vectors
    give no rows. Of equal eigenvalues any basis may come. ``deviation`` is null
    where no long holds it. Other columns are not read.
    """
    key = vectors.schema[id_col].dataType.simpleString()
    shape = f"id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = grid(vectors, id_col, vector_col)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = _padded(rows, width)
    with scratch(vectors.sparkSession) as put:
        found = fit_whitening(put(rows.select("x").distinct(), "grid"), width, wanted) if width else None
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], shape)
    mean, scaled, share = found.mean, found.components / np.sqrt(found.values), found.values / found.trace
    n, sums, error, k = found.n, found.sums, found.identity_error, len(found.values)
    names = [f.split()[0] for f in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), width)
            far = pa.array(deviations(x, n, sums)[0], pa.int64())
            z = (x - mean) @ scaled
            for c in range(k):
                same = lambda v, t: pa.array(np.full(b.num_rows, v), t)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), same(c + 1, pa.int32()), same(n, pa.int64()), far, pa.array(z[:, c].copy()), same(share[c], pa.float64()), same(error, pa.float64())], names
                )

    return rows.mapInArrow(run, shape)
