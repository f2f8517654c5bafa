"""Whitening of embeddings on their leading components, found by a randomised range finder.

Entries are rounded down to whole numbers first, so that sums and deviations are exact. Equal vectors count once in the fit. The range
finder multiplies a few random directions by the covariance, again and again, each time in one pass over all centred rows that ends in a sum of
small matrices; Rayleigh-Ritz in the span gives components, and their residuals say how far off they can be. Where passes do not settle
them, the span is widened to all dimensions, which is exact.

What reaches the driver are matrices of dimensions by directions, whatever the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Added to a rounded entry.
SHIFT = 1_000_000
#: Entries beyond this size are not whole numbers a long could hold exactly.
MOST = float(1 << 52)


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` finds. ``components`` has a unit eigenvector a row, by falling eigenvalue."""

    n: int
    dims: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    components: np.ndarray
    residuals: np.ndarray
    passes: int
    full: bool
    identity_error: float

    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)[:, None]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


def grid(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, x): floor(scale * entry) + SHIFT for vectors without null or non-finite entries; others go, and so do vectors that are null.

    An entry whose whole number has more than 52 bits makes the job fail.
    """
    v = F.col("__v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.when(F.abs(c) < MOST / scale, F.floor(c * F.lit(scale)) + F.lit(SHIFT)).otherwise(F.raise_error(F.lit("an entry is too large to round")).cast("long"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("__v"))
    return rows.where(v.isNotNull() & ~bad).select("id", F.transform(v, whole).alias("x"))


def _summed(partials: DataFrame, rows: int) -> np.ndarray:
    """The sum of matrices that come in rows (i, r), a row of each from every task; a row's sum is made by one task, in place."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(b.column(0).to_pylist(), b.column(1)):
                r = np.asarray(r.values)
                total[i] = total[i] + r if i in total else r.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "r"])

    found = partials.repartition("i").mapInArrow(add, "i int, r array<double>").collect()
    if not found:
        return np.zeros((rows, 0))
    out = np.zeros((rows, len(found[0].r)))
    for row in found:
        out[row.i] = row.r
    return out


def _sums(dims: int):
    """(i, s): exact sums of each dimension over a task's rows. Of 52 bits each, 1024 fit a long."""

    def run(batches):
        total = np.zeros(dims, dtype=object)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                total += _matrix(b.column(0).slice(at, 1024), dims).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    return run


def _pass(fit: DataFrame, dims: int, mean: tuple[np.ndarray, np.ndarray], q: np.ndarray) -> np.ndarray:
    """Sum over all rows of x'(x q), x being centred first: (dims, directions); the last row has the sum of squares of x."""
    whole, part = mean

    def run(batches):
        total, squares = np.zeros((dims, q.shape[1])), 0.0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = (_matrix(b.column(0).slice(at, 4096), dims) - whole) - part
                total += x.T @ (x @ q)
                squares += float(np.einsum("ij,ij->", x, x))
        rows = [*total, np.full(q.shape[1], squares)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "r"])

    return _summed(fit.mapInArrow(run, "i int, r array<double>"), dims + 1)


def _ritz(q: np.ndarray, image: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, vectors (columns) and residual norms in the span of ``q``, whose image under the scatter matrix is known."""
    t = q.T @ image / n
    values, w = np.linalg.eigh((t + t.T) / 2)
    order = np.argsort(values)[::-1]
    values, w = values[order], w[:, order]
    u = q @ w
    return values, u, np.linalg.norm(image @ w / n - u * values, axis=0)


def _settled(values: np.ndarray, residuals: np.ndarray, most: int, tolerance: float) -> bool:
    """Whether the first components are within ``tolerance``: a residual over the gap to the next values bounds the angle of a component."""
    gaps = np.minimum(np.abs(np.diff(values, prepend=np.inf)), np.abs(np.diff(values, append=-np.inf)))[:most]
    return bool((residuals[:most] <= tolerance * gaps).all())


def fit(x: DataFrame, *, components: int = 16, oversampling: int = 10, passes: int = 12, tolerance: float = 1e-11, seed: int = 11) -> Whitening | None:
    """Components of the covariance (divisor n) of the distinct vectors ``x`` (arrays of whole numbers); None if there is none.

    All vectors must have one length. A component's eigenvalue must exceed rounding (dims * 2e-16 of the largest), as nothing can be
    scaled to variance one otherwise; there may thus be fewer than ``components``. Reruns give the same, but for the last bits.
    """
    rows = materialize(x.select("x").distinct(), "fit")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not dims:
        return None
    sums = [0] * dims
    for r in rows.mapInArrow(_sums(dims), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r.i] = int(r.s)
    # x - S/n = (x - whole) - part: the first difference is exact, so no digits of the mean are lost
    mean = np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])
    width = min(dims, components + oversampling)
    q = np.eye(dims) if width == dims else np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    done = 0
    while True:
        image = _pass(rows, dims, mean, q)
        image, trace = image[:dims], float(image[dims, 0]) / n
        done += 1
        values, vectors, residuals = _ritz(q, image, n)
        full = q.shape[1] == dims
        if full or _settled(values, residuals, components, tolerance):
            break
        if done >= passes:
            q = np.eye(dims)
        else:
            q = np.linalg.qr(image)[0]
    keep = np.flatnonzero(values[:components] > dims * 2e-16 * max(values[0], 0.0)) if trace > 0 else np.zeros(0, dtype=int)
    chosen = vectors[:, keep].T
    # either sign is right: the largest entry is positive, so that reruns agree
    chosen = chosen * np.where(chosen[np.arange(len(chosen)), np.abs(chosen).argmax(axis=1)] < 0, -1.0, 1.0)[:, None] if len(keep) else chosen
    error = _identity_error(rows, mean, chosen / np.sqrt(values[keep])[:, None], n) if len(keep) else 0.0
    return Whitening(n, dims, tuple(sums), trace, values[keep], chosen, residuals[keep], done, full, error)


def _identity_error(fit: DataFrame, mean: tuple[np.ndarray, np.ndarray], scaled: np.ndarray, n: int) -> float:
    """Largest entry of the whitened rows' covariance less the identity, in one more pass over all rows."""
    whole, part = mean
    k, dims = scaled.shape

    def run(batches):
        total, sums = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                y = ((_matrix(b.column(0).slice(at, 4096), dims) - whole) - part) @ scaled.T
                total += y.T @ y
                sums += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array([*total, sums], pa.list_(pa.float64()))], names=["i", "r"])

    found = _summed(fit.mapInArrow(run, "i int, r array<double>"), k + 1)
    centre = found[k] / n
    return float(np.abs(found[:k] / n - np.outer(centre, centre) - np.eye(k)).max())


def _projected(model: Whitening):
    sums, n, dims, k = np.array(model.sums, dtype=object), model.n, model.dims, len(model.values)
    whole, part = np.array([s // n for s in model.sums], dtype=np.int64), np.array([(s % n) / n for s in model.sums])
    rest = np.array([s % n for s in model.sums], dtype=object)
    scaled, explained = model.scaled(), model.values / model.trace

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                piece = b.slice(at, 2048)
                x = _matrix(piece.column(1), dims)
                near = x - whole
                # n * x - S = n * (x - whole) - rest, in longs while they suffice
                bound = n * (int(np.abs(near).max(initial=0)) + 1)
                if bound * bound * dims < 1 << 62:
                    deviation = ((n * near - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
                y = (near - part) @ scaled.T
                rows = np.repeat(np.arange(len(x)), k)
                deviations = pa.array([Decimal(int(d)) for d in deviation], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)).astype(np.int32)), deviations.take(pa.array(rows)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x)))],
                    names=["id", "component", "deviation", "whitened", "explained"],
                )

    return run


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, components: int = 16, **fitting) -> DataFrame:
    """(id_col, component, n, deviation decimal(38,0), whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null or hold null or non-finite entries give no rows and do not count. Vectors have the length that most of
    them have, of lengths that tie the least; others give no rows either. Rows that repeat an id or have none are vectors of their own; equal
    vectors are fitted once and all come out. Components without variance are left out: an empty table, one distinct vector or empty
    vectors give no rows. Columns but the named ones are not read.
    """
    x = materialize(grid(vectors, id_col=id_col, vector_col=vector_col, scale=scale), "grid")
    lengths = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.col("count").desc(), "dims").limit(2).collect()
    if len(lengths) > 1:
        x = x.where(F.size("x") == lengths[0].dims)
    model = fit(x, components=components, **fitting) if lengths else None
    kind = x.schema["id"].dataType.simpleString()
    fields = f"id {kind}, component int, deviation decimal(38,0), whitened double, explained double"
    if model is None or not len(model.values):
        rows, n, error = x.sparkSession.createDataFrame([], fields), 0, 0.0
    else:
        rows, n, error = x.mapInArrow(_projected(model), fields), model.n, model.identity_error
    return rows.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
