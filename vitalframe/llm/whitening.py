"""Whitening of embeddings: distributed centred covariance, own eigensolver, broadcast projection.

1.  Entries become whole numbers x = floor(scale * c) + offset; the fit list is each
    distinct x vector once, written as a table.
2.  One pass sums n and the dimensions (exactly); a second one sums the products of
    the centred vectors, (n * x - S) / n.  Tasks hand on one matrix each, which is
    summed row by row of the matrix in a streamed second step.
3.  The covariance is of (dimension x dimension) numbers, at most ``MOST_DIMENSIONS``
    squared, and goes to the driver: Householder reflections make it tridiagonal,
    bisection on Sturm counts finds the leading eigenvalues, inverse iteration their
    vectors, orthogonalised again within clusters of close eigenvalues.
4.  The projection (dimension x components) is broadcast; one pass over all rows
    gives the result, one more over the fit list the error against the identity.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries go;
so do empty vectors and those whose length isn't the most frequent one (ties: the
longest).  Rows that repeat are all returned, and fitted once; a null id stays.
Entries so large that x passes 2**52 are cut to it.  A component without variance (an
eigenvalue below 1e-13 of the trace, as with few distinct vectors) has no whitened
value (null), and identity_error is over the others (0 if there is none); explained
is 0 without any variance.  A deviation beyond a long is null.  An empty table gives
no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

COMPONENTS = 16
SCALE = 64.0
OFFSET = 1_000_000
MOST_DIMENSIONS = 4096   # the driver holds a few matrices of this size squared
_MOST = float(1 << 52)
_ROWS = 4096             # vectors that a task multiplies at once
_NO_VARIANCE = 1e-13


# ---- eigenvalues and vectors of a symmetric matrix -------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and the Householder reflections that make ``a`` tridiagonal."""
    a = np.array(a, float)
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1:, k]
        rest = np.abs(x[1:]).max(initial=0.0)
        if rest == 0.0:
            reflections.append(None)
            continue
        big = max(rest, abs(x[0]))
        v = x / big
        norm = np.sqrt(v @ v)
        alpha = -norm if v[0] >= 0 else norm
        v[0] -= alpha
        v /= np.sqrt(v @ v)
        # (1 - 2 v v') B (1 - 2 v v') as a rank-two update of the trailing block
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = 2.0 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = 0.0
        a[k + 1, k] = alpha * big
        a[k, k + 1:] = a[k + 1:, k]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def _back(vectors: np.ndarray, reflections: list) -> np.ndarray:
    """Vectors (as columns) of the tridiagonal matrix as vectors of the original one."""
    out = vectors.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        if v is not None:
            out[k + 1:] -= 2.0 * np.outer(v, v @ out[k + 1:])
    return out


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvalues of the tridiagonal matrix below each x: negative pivots of T - x."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    least = max(least, np.finfo(float).eps ** 2 * float(np.max(e * e, initial=0.0)))
    count = np.zeros(len(x), np.int64)
    q = np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)  # a vanishing pivot counts as a negative one
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(d)
    reach = np.zeros(n)
    reach[:-1] += np.abs(e)
    reach[1:] += np.abs(e)
    span = max(np.max(np.abs(d) + reach), np.finfo(float).tiny)
    want = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    lo, hi = np.full(k, np.min(d - reach) - span * 1e-12), np.full(k, np.max(d + reach) + span * 1e-12)
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        above = sturm_count(d, e, mid) > want
        hi = np.where(above, mid, hi)
        lo = np.where(above, lo, mid)
    return np.maximum.accumulate((lo + (hi - lo) / 2)[::-1])[::-1]


def _solver(d: np.ndarray, e: np.ndarray, shift: float):
    """Solve (T - shift) x = b by elimination with row exchanges; a vanishing pivot becomes a tiny one."""
    n = len(d)
    tiny = np.finfo(float).eps * max(np.max(np.abs(d)), np.max(np.abs(e), initial=0.0), np.finfo(float).tiny)
    a = d - shift
    up, up2 = np.append(e, 0.0), np.zeros(n)
    low, factor, swap = e.copy(), np.zeros(n), np.zeros(n, bool)
    a = a.copy()
    for i in range(n - 1):
        if abs(a[i]) >= abs(low[i]):
            if a[i] == 0.0:
                a[i] = tiny
            factor[i] = low[i] / a[i]
            a[i + 1] -= factor[i] * up[i]
        else:
            swap[i] = True
            factor[i] = a[i] / low[i]
            a[i], keep = low[i], up[i]
            up[i] = a[i + 1]
            a[i + 1] = keep - factor[i] * up[i]
            up2[i] = up[i + 1]
            up[i + 1] = -factor[i] * up2[i]
    a = np.where(np.abs(a) < tiny, np.where(a < 0, -tiny, tiny), a)

    def solve(b):
        x = b.copy()
        for i in range(n - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        x[n - 1] /= a[n - 1]
        for i in range(n - 2, -1, -1):
            x[i] = (x[i] - up[i] * x[i + 1] - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / a[i]
        return x

    return solve


def _vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of the tridiagonal matrix for falling eigenvalues, as columns."""
    n, eps = len(d), np.finfo(float).eps
    norm = max(np.max(np.abs(d)) + 2 * np.max(np.abs(e), initial=0.0), np.finfo(float).tiny)
    rng = np.random.default_rng(17)
    out = np.zeros((n, len(values)))
    cluster, shift = 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        # equal eigenvalues get shifts a little apart, else their iterations would agree
        shift = value if j == cluster else min(value, shift - 10 * eps * norm)
        solve = _solver(d, e, shift)
        x = rng.standard_normal(n)
        for _ in range(6):
            before = x / np.sqrt(x @ x)
            x = solve(before)
            x /= np.max(np.abs(x))
            for _ in range(2):
                near = out[:, cluster:j]
                x -= near @ (near.T @ x)
            x /= np.sqrt(x @ x)
            if abs(abs(x @ before) - 1.0) < 4 * eps:
                break
        out[:, j] = x
    return out


def leading_eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit vectors as columns (the entry of
    largest size, the first of them, is positive)."""
    k = min(k, len(a))
    scale = np.max(np.abs(a), initial=0.0)
    if scale == 0.0:
        return np.zeros(k), np.eye(len(a))[:, :k]
    if len(a) == 1:
        return np.array([a[0, 0]], float), np.ones((1, 1))
    d, e, reflections = tridiagonal(a / scale)
    values = leading_values(d, e, k)
    vectors = _back(_vectors(d, e, values), reflections)
    vectors /= np.sqrt((vectors ** 2).sum(axis=0))
    sign = np.sign(vectors[np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=0) * (1 - 1e-9), axis=0), np.arange(k)])
    return values * scale, vectors * np.where(sign == 0, 1.0, sign)


# ---- passes over the table -------------------------------------------------------------------------

def _quantised(column: pa.Array, dims: int, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable rows and their x vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.cast(pa.list_(pa.float64()))
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dims)
    if not len(at) or dims < 1:
        return np.zeros(0, np.int64), np.zeros((0, max(dims, 0)), np.int64)
    flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dims)  # null: NaN
    ok = np.isfinite(flat).all(axis=1)
    x = np.clip(np.floor(np.clip(flat[ok], -_MOST, _MOST) * scale), -_MOST, _MOST).astype(np.int64) + offset
    return at[ok], x


def _packed(x: np.ndarray, offset: int) -> list:
    """Each vector as bytes of the smallest of three widths that holds it: equal vectors, equal bytes."""
    x = x - offset
    top = np.abs(x).max(axis=1)
    out = np.empty(len(x), object)
    for dtype, least, most in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 62)):
        at = np.flatnonzero((top >= least) & (top < most))
        if len(at):
            out[at] = [r.tobytes() for r in x[at].astype(dtype)]
    return out.tolist()


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, offset: int) -> Iterator[np.ndarray]:
    for b in batches:
        values = b.column(0).to_pylist()
        for width in (2, 4, 8):
            flat = np.frombuffer(b"".join(v for v in values if len(v) == width * dims), f"<i{width}").reshape(-1, dims)
            for lo in range(0, len(flat), _ROWS):
                yield flat[lo:lo + _ROWS].astype(np.int64) + offset


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """(x - S / n) by way of the whole numbers n * x - S, where they fit 62 bits."""
    whole = [round(Decimal(s) / n) for s in sums]
    rest = np.array([float(Decimal(s - n * w) / n) for s, w in zip(sums, whole, strict=True)])
    return (x - np.array(whole, np.int64)).astype(float) - rest


def _deviation(x: np.ndarray, n: int, sums: list) -> list:
    """Sum of (n * x - S) ** 2 over the dimensions, exact; None beyond a long."""
    whole = [round(Decimal(s) / n) for s in sums]
    near = x - np.array(whole, np.int64)
    rest = np.array([s - n * w for s, w in zip(sums, whole, strict=True)], dtype=object)
    top = int(np.abs(near).max(initial=0)) * n + int(max((abs(r) for r in rest), default=0))
    if top * top * x.shape[1] < 1 << 62:
        t = near * n - rest.astype(np.int64)
        return (t * t).sum(axis=1).tolist()
    out = ((near.astype(object) * n - rest) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in out]


def _summed(parts: DataFrame) -> dict:
    """Sum the arrays of rows (i, v) by i, in two streamed steps; at most one row per i reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v, "<f8")
                held[i] = held[i] + v if i in held else v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()),
                                              pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["i", "v"])

    # in one order of the parts, so that reruns add in the same order
    ranged = parts.repartition("i").sortWithinPartitions("i", F.xxhash64("v"))
    return {r["i"]: np.frombuffer(r["v"], "<f8") for r in ranged.mapInArrow(run, "i int, v binary").collect()}


def _products(fit: DataFrame, dims: int, offset: int, of) -> np.ndarray:
    """Sum of outer products of ``of(x)`` (and, as a last row, its sum) over the fit list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, dims, offset):
            y = of(x)
            m = np.vstack([y.T @ y, y.sum(axis=0)])
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()),
                                              pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())],
                                             names=["i", "v"])

    rows = _summed(fit.mapInArrow(run, "i int, v binary"))
    return np.array([rows[i] for i in range(len(rows))])


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), whitened vectors in long form."""
    vector = F.col(f"`{vector_col}`")
    rows = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("_v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    out_schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
                  "identity_error double")
    common = (rows.where(F.size("_v") > 0).groupBy(F.size("_v").alias("d")).count()
              .orderBy(F.desc("count"), F.desc("d")).first())
    if common is None:
        return embeddings.sparkSession.createDataFrame([], out_schema)
    dims = common["d"]
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; the eigensolver takes {MOST_DIMENSIONS} at most")

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = _quantised(b.column(0), dims, scale, offset)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(_packed(x, offset), pa.binary())], names=["x"])

    fit = cut_lineage(rows.select("_v").mapInArrow(quantise, "x binary").distinct(), "whiten-fit")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for x in _blocks(batches, dims, offset):
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, _exact_sums(x), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                 pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["i", "n", "s"])

    found = {r["i"]: (r["n"], int(r["s"])) for r in
             fit.mapInArrow(totals, "i int, n long, s decimal(38,0)").groupBy("i")
             .agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    if not found:
        return embeddings.sparkSession.createDataFrame([], out_schema)
    n, sums = found[0][0], [found[i][1] for i in range(dims)]
    cov = _products(fit, dims, offset, lambda x: _centred(x, n, sums))[:dims] / n
    values, vectors = leading_eigen((cov + cov.T) / 2, components)
    trace = float(np.trace(cov))
    used = values > _NO_VARIANCE * trace if trace > 0 else np.zeros(len(values), bool)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    weights = np.where(used, vectors / np.sqrt(np.where(used, values, 1.0)), 0.0)

    error = 0.0
    if used.any():
        m = _products(fit, dims, offset, lambda x: _centred(x, n, sums) @ weights[:, used])
        mean = m[-1] / n  # of centred numbers: zero but for rounding
        error = float(np.max(np.abs(m[:-1] / n - np.outer(mean, mean) - np.eye(int(used.sum())))))

    shared = embeddings.sparkSession.sparkContext.broadcast(weights)
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            at, x = _quantised(b.column(1), dims, scale, offset)
            for lo in range(0, len(at), _ROWS):
                part, rows_at = x[lo:lo + _ROWS], at[lo:lo + _ROWS]
                y = _centred(part, n, sums) @ w
                ids = b.column(0).take(pa.array(np.repeat(rows_at, k)))
                deviation = np.repeat(np.array(_deviation(part, n, sums), dtype=object), k)
                size = len(rows_at) * k
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1), len(rows_at)), pa.int32()),
                     pa.array(np.full(size, n), pa.int64()), pa.array(deviation.tolist(), pa.int64()),
                     pa.array(y.ravel(), pa.float64(), mask=np.tile(~used, len(rows_at))),
                     pa.array(np.tile(explained, len(rows_at)), pa.float64()),
                     pa.array(np.full(size, error), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, out_schema)


def _exact_sums(x: np.ndarray) -> list:
    """Column sums of at most ``_ROWS`` whole numbers below 2**53, exact: the two halves of the bits apart."""
    high = (x >> 26).sum(axis=0)
    low = (x & ((1 << 26) - 1)).sum(axis=0)
    return [(int(h) << 26) + int(lo) for h, lo in zip(high, low, strict=True)]
