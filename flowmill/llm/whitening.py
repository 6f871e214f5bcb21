"""Whitening of embeddings: principal components of all vectors by shifted CholeskyQR."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers beyond this have no place: their sums over a partition would not be exact.
MOST = 2**31
#: Passes of Cholesky factors at most, the shifted ones included; three do for all but degenerate tables.
PASSES = 6
#: Bytes of partial Gram matrices that reach the driver at most, whatever the number of partitions.
GATHERED = 1 << 26
UNIT = 2.0**-53


class Whitening(NamedTuple):
    """n vectors with per-dimension sums (whole numbers, exact, offset included); eigenvectors of their covariance as columns
    of axes, by falling eigenvalue; their eigenvalues, and the passes it took."""

    n: int
    sums: list
    axes: np.ndarray
    values: np.ndarray
    passes: int


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that count, and they themselves as rows of doubles. Null and empty vectors, and those with a
    null or non-finite component, do not count; vectors of several lengths are an error."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths)
    if not len(at):
        return at, np.zeros((0, 0))
    dims = lengths[at[0]]
    if (lengths[at] != dims).any():
        raise ValueError(f"vectors have several lengths: {sorted(set(lengths[at].tolist()))[:5]}")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    good = np.isfinite(rows).all(1)
    return at[good], rows[good]


def whole(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers; an error where they are MOST or more."""
    y = np.floor(scale * rows)
    if len(y) and np.abs(y).max() >= MOST:
        raise ValueError(f"a component times {scale} is {MOST} or more")
    return y.astype(np.int64)


def forward(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q r = rows, r being upper triangular: a triangular solve, a column at a time for all rows."""
    q = np.empty_like(rows)
    for j in range(r.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _added(parts: DataFrame, cells: int) -> np.ndarray:
    """The sum of the arrays in parts (column g: cells doubles as bytes, one row for each partition). They are added up in a
    few tasks first, so the driver gets GATHERED bytes at most."""

    def add(batches):
        total = np.zeros(cells)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    few = max(1, min(32, GATHERED // (8 * cells)))
    return sum((np.frombuffer(r.g) for r in parts.repartition(few).mapInArrow(add, "g binary").collect()), np.zeros(cells))


def _gram(vectors: DataFrame, dims: int, of) -> np.ndarray:
    """The sum over all vectors of q qᵀ, q being of(rows)."""

    def partial(batches):
        total = np.zeros((0, 0))
        for b in batches:
            _, rows = matrix(b.column(0))
            if len(rows):
                q = of(rows)
                total = q.T @ q + (total if total.size else 0)
        if total.size:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    return _added(vectors.mapInArrow(partial, "g binary"), dims * dims).reshape(dims, dims)


def _sums(vectors: DataFrame, scale: float) -> tuple[int, list[int]]:
    """Number of the vectors and the exact sums of their whole numbers; none and no sums if there are no vectors."""

    def partial(batches):
        for b in batches:
            _, rows = matrix(b.column(0))
            if len(rows):
                # a batch has far fewer rows than 2**31, so its sums of numbers below 2**31 are exact
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([whole(rows, scale).sum(0).tolist()], pa.list_(pa.int64()))], ["n", "s"])

    parts = vectors.mapInArrow(partial, "n long, s array<long>")
    got = parts.groupBy(F.size("s").alias("dims")).agg(F.sum("n").alias("n")).collect()
    if len(got) > 1:
        raise ValueError(f"vectors have several lengths: {sorted(r.dims for r in got)}")
    if not got:
        return 0, []
    s = parts.select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return got[0].n, [int(r.v) for r in sorted(s, key=lambda r: r.k)]


def cholesky(g: np.ndarray, n: int, shifted: bool) -> np.ndarray | None:
    """The upper triangular R with Rᵀ R = g, of g plus a shift on its diagonal if shifted; None if there is none. The shift,
    11 (n d + d (d + 1)) u |g|, is above what rounding may have made of g, so its factor exists."""
    d = len(g)
    if shifted:
        g = g + np.eye(d) * max(11 * (n * d + d * (d + 1)) * UNIT * np.linalg.norm(g, 2), np.finfo(float).tiny)
    try:
        r = np.linalg.cholesky(g).T
    except np.linalg.LinAlgError:
        return None
    return r if shifted or np.diag(r).min() > 1e-6 * np.diag(r).max() else None


def fit(vectors: DataFrame, scale: float = 64.0, offset: int = 1_000_000) -> Whitening | None:
    """Principal components of x = floor(scale * c) + offset over the vectors c in the only column of vectors, by shifted
    CholeskyQR. The centred rows are never gathered or written: each pass reads the vectors, applies the triangular solves
    of the factors found so far and adds up the Gram matrix of what comes out, which is all that the driver sees (d x d,
    d being the number of dimensions). Once rows are orthonormal, the factors compose to R with Rᵀ R = n V, and the
    singular vectors of R are the components: V itself, whose condition is that of R squared, is never decomposed. None
    if no vector counts.

    A direction without variance can't be made orthonormal; then the last Gram matrix's root takes part instead of its
    Cholesky factor, which R's definition allows. The order in which partial sums arrive varies, so reruns may differ in
    last bits; within a run all rows get the same components."""
    n, sums = _sums(vectors, scale)
    if not n:
        return None
    d, factors = len(sums), []
    mean = np.array([s / n for s in sums])

    def rows_of(rows: np.ndarray) -> np.ndarray:
        q = whole(rows, scale) - mean
        for r in factors:
            q = forward(q, r)
        return q

    for k in range(PASSES):
        g = _gram(vectors, d, rows_of)
        if np.abs(g - np.eye(d)).max() < 1e-12 * d:
            break
        r = cholesky(g, n, shifted=k == 0)
        if r is None and k == 1:  # the first shift was large: once more
            r = cholesky(g, n, shifted=True)
        if r is None:  # what is not orthonormal now has no variance
            break
        factors.append(r)
    w, u = np.linalg.eigh(g)
    total = np.sqrt(np.clip(w, 0, None))[:, None] * u.T
    for r in reversed(factors):
        total = total @ r
    _, s, vt = np.linalg.svd(total)
    return Whitening(n, [x + n * offset for x in sums], vt.T.copy(), s * s / n, k + 1)


def apply(table: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """A row for each vector that counts, repeats included: id_col as it is, n, deviation (sum over the dimensions of
    (n x - S)**2, exact, decimal) and whitened: (x - S / n) on each of the first most components, over the square root
    of its eigenvalue. On a component without variance (below 1e-20 of the largest eigenvalue) every vector has 0."""
    n, dims = model.n, len(model.sums)
    low = [s - n * offset for s in model.sums]
    mean = np.array([s / n for s in low])
    k = min(most, dims)
    some = model.values[:k] > 1e-20 * max(model.values[0], np.finfo(float).tiny)
    axes = np.where(some, model.axes[:, :k] / np.sqrt(np.where(some, model.values[:k], 1.0)), 0.0)
    # sum (n y - s)**2 = n**2 sum y**2 - 2 n sum y s + sum s**2; whole numbers of any size where 64 bits may not do
    largest, squares = max(map(abs, low)), sum(s * s for s in low)
    sums = np.array(low, np.int64 if largest < 2**62 else object)

    def run(batches):
        for b in batches:
            at, rows = matrix(b.column(1))
            y = whole(rows, scale) if len(rows) else np.zeros((0, dims), np.int64)
            big = int(np.abs(y).max(initial=0))
            z = y.astype(object) if big * max(largest, big) * dims >= 2**62 else y
            exact = [n * n * int(a) - 2 * n * int(c) + squares for a, c in zip((z * z).sum(1), z @ (sums if z is y else sums.astype(object)))]
            q = (y.astype(np.float64) - mean) @ axes
            out = pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([str(v) for v in exact], pa.string()), out], ["id", "deviation", "whitened"])

    kind = table.schema[id_col].dataType.simpleString()
    out = table.select(id_col, vector_col).mapInArrow(run, f"id {kind}, deviation string, whitened array<double>")
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def identity_error(vectors: DataFrame, model: Whitening, most: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over the components with variance, from
    all vectors in the only column of vectors and about their own mean."""
    n, dims = model.n, len(model.sums)
    k = min(most, dims)
    some = np.flatnonzero(model.values[:k] > 1e-20 * max(model.values[0], np.finfo(float).tiny))
    axes = model.axes[:, some] / np.sqrt(model.values[some])
    mean = np.array([s / n - offset for s in model.sums])
    center = np.zeros(len(some))

    def ones(rows):
        return np.c_[(whole(rows, scale) - mean) @ axes - center, np.ones(len(rows))]

    center = _gram(vectors, len(some) + 1, ones)[-1, :-1] / n
    c = _gram(vectors, len(some) + 1, ones)[:-1, :-1] / n
    return float(np.abs(c - np.eye(len(some))).max(initial=0.0))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """A row for each vector that counts and each of the first most components: id_col, component (from 1), n, deviation,
    whitened, explained (the eigenvalue's share of the trace, 0 where nothing varies) and identity_error. All columns of
    the table but these two are left alone; no vectors give no rows."""
    vectors = table.select(F.col(vector_col).alias("v"))
    model = fit(vectors, scale, offset)
    if model is None:
        empty = f"{id_col} {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], empty)
    error = identity_error(vectors, model, most, scale, offset)
    trace = float(model.values.sum())
    share: Column = F.array(*(F.lit(float(v) / trace if trace else 0.0) for v in model.values[:most]))
    out = apply(table, model, id_col, vector_col, most, scale, offset)
    out = out.select(id_col, "n", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return out.select(id_col, (F.col("_k") + 1).alias("component"), "n", "deviation", "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error"))
