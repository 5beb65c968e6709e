"""Embedding whitening on components found by QDWH spectral divide and conquer.

1. Entries become integers floor(scale * c) + shift. One pass over all usable
   vectors gives their number, exact sums per dimension and the scatter matrix:
   every batch is centred on its own mean before it is multiplied, and batches and
   tasks are merged by the pairwise update of means and scatters, as a tree of
   k x k blocks.
2. The k x k covariance is split on the driver. The orthogonal polar factor U of
   V - s I, by the QR- and Cholesky-based dynamically weighted Halley iteration,
   gives the projector (U + I) / 2 on the eigenvalues above s; its range and the
   orthogonal complement carry two smaller symmetric matrices, which are split again
   until each is diagonal to rounding. The larger part is split first, so what lies
   below the wanted components is left whole.
3. The components over the square roots of their eigenvalues, k x ``components``
   numbers, are broadcast, and every vector is projected on its own.

Defined results: rows whose vector is null, empty or holds null or non-finite entries
are dropped. The dimension is that of most vectors (the smaller of equally frequent
ones); vectors of another dimension are dropped as well. Integers are held within
2^53 of zero. Repeated rows and rows without an id count and are returned like all
others. A component without variance (eigenvalue of at most k roundings of the
largest) has the explained share 0 and whitened null; where the trace is 0 the share
is null. Deviations that a long does not hold are null. Empty tables give empty
tables; further columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.blocks import tree_reduce

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: A k x k matrix of doubles has to fit the driver.
MAX_DIMENSION = 4_096
_MOST = 2.0**53
_EPS = np.finfo(float).eps


# -- polar decomposition and splitting of a symmetric matrix ------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # a lower bound of the smallest singular value, from the triangle of a QR
    triangle = np.linalg.qr(x, mode="r")
    low = np.abs(np.diag(triangle)).min() / n
    if low > 0:
        with np.errstate(all="ignore"):
            inverse = np.linalg.norm(np.linalg.inv(triangle))
        low = 1 / inverse if np.isfinite(inverse) and inverse > 0 else low
    low = min(max(low, 1e-17), 1.0)
    eye = np.eye(n)
    for _ in range(30):
        square = low * low
        root = np.cbrt(4 * (1 - square) / square**2) if square < 1 else 0.0
        half = np.sqrt(1 + root)
        alpha = half + 0.5 * np.sqrt(max(8 - 4 * root + 8 * (2 - square) / (square * half), 0.0))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        low = min(low * (alpha + beta * square) / (1 + gamma * square), 1.0)
        if gamma > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, eye]))
            step = q[:n] @ q[n:].T / np.sqrt(gamma)
        else:
            chol = np.linalg.cholesky(eye + gamma * (x.T @ x))
            step = np.linalg.solve(chol.T, np.linalg.solve(chol, x.T)).T
        new = beta / gamma * x + (alpha - beta / gamma) * step
        new = (new + new.T) / 2
        change, x = np.linalg.norm(new - x), new
        if change <= n * _EPS**0.5 and 1 - low <= 10 * _EPS:
            break
    # one Newton-Schulz step takes the last rounding off
    x = 1.5 * x - 0.5 * x @ (x @ x)
    return (x + x.T) / 2


def _shifts(a: np.ndarray):
    """Places to split at: middles of the diagonal first, then draws from where the eigenvalues can be."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    gap = int(np.argmax(np.diff(diagonal)))
    yield float(diagonal[gap] + diagonal[gap + 1]) / 2
    mean = float(diagonal.mean())
    yield mean
    spread = float(np.linalg.norm(a - mean * np.eye(len(a))))
    draw = np.random.default_rng(len(a))
    for k in range(60):
        yield mean + float(draw.uniform(-1, 1)) * spread / (1 + k % 8)


def _bases(projector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the projector's range and of its complement."""
    draw = np.random.default_rng(k).standard_normal((len(projector), k))
    q, _ = np.linalg.qr(projector @ draw)
    q, _ = np.linalg.qr(projector @ q, mode="complete")
    return q[:, :k], q[:, k:]


def _divided(a: np.ndarray, scale: float):
    """(upper basis, lower basis) of two invariant subspaces, the eigenvalues of the first being the larger."""
    n, best = len(a), None
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        projector = (polar_factor(moved) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        upper, lower = _bases(projector, k)
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= 4 * n * _EPS * scale:
            break
    if best is None:
        raise ArithmeticError("no shift divides the spectrum")
    return best[1], best[2]


def components_of(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale, values, vectors = float(np.linalg.norm(a)), [], []
    waiting = [(np.asarray(a, float), np.eye(len(a)))]
    while waiting and len(values) < wanted:
        part, basis = waiting.pop()
        part = (part + part.T) / 2
        n = len(part)
        rest = part - np.diag(np.diag(part))
        if n == 1 or np.linalg.norm(rest) <= 2 * _EPS * scale:
            for k in np.argsort(-np.diag(part), kind="stable"):
                values.append(part[k, k])
                vectors.append(basis[:, k])
            continue
        if n == 2:
            # one rotation
            angle = 0.5 * np.arctan2(2 * part[0, 1], part[0, 0] - part[1, 1])
            upper, lower = np.array([[np.cos(angle)], [np.sin(angle)]]), np.array([[-np.sin(angle)], [np.cos(angle)]])
            if (upper.T @ part @ upper)[0, 0] < (lower.T @ part @ lower)[0, 0]:
                upper, lower = lower, upper
        else:
            upper, lower = _divided(part, scale)
        waiting.append((lower.T @ part @ lower, basis @ lower))
        waiting.append((upper.T @ part @ upper, basis @ upper))
    chosen = sorted(range(len(values)), key=lambda k: -values[k])[:wanted]
    vectors = np.array([vectors[k] / np.linalg.norm(vectors[k]) for k in chosen]).T.reshape(len(a), len(chosen))
    return np.array([values[k] for k in chosen]), vectors


# -- moments ------------------------------------------------------------------


def _merged(a: bytes, b: bytes) -> bytes:
    (n, sums, mean, scatter), (m, more, other, added) = pickle.loads(a), pickle.loads(b)
    apart = other - mean
    scatter = scatter + added + np.outer(apart, apart) * (n * m / (n + m))
    return pickle.dumps((n + m, [x + y for x, y in zip(sums, more)], mean + apart * (m / (n + m)), scatter))


def moments(df: DataFrame, k: int, decode):
    """(number, exact sums, scatter matrix) of the vectors of length ``k`` that ``decode`` makes of a batch; None without rows.

    ``decode`` gives integers, for exact sums, or doubles, whose sums are not used.
    """

    def reduce(batches):
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = decode(batch)
            exact = found.dtype == np.int64
            sums = [0] * k
            if exact:
                for at in range(0, len(found), 512):
                    sums = [s + int(x) for s, x in zip(sums, found[at : at + 512].sum(0))]
            x = found.astype(float)
            mean = np.array([s / len(x) for s in sums]) if exact else x.mean(0)
            x = x - mean
            one = pickle.dumps((len(x), sums, mean, x.T @ x))
            state = one if state is None else _merged(state, one)
        return state

    state = tree_reduce(df, reduce, _merged, 8 * (k * k + 8 * k) + 200)
    if state is None:
        return None
    n, sums, _, scatter = pickle.loads(state)
    return n, sums, scatter


@dataclass
class Whitening:
    """A fitted model: number and exact sums of the integer vectors, components (columns) with their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    scale: int
    shift: int

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def explained(self) -> list[float | None]:
        return [None if self.trace <= 0 else max(float(v), 0.0) / self.trace for v in self.values]

    def varies(self) -> np.ndarray:
        least = self.dimension * _EPS * max(float(self.values[0]), 0.0) if len(self.values) else 0.0
        return self.values > least


def usable(df: DataFrame, vector: str, vec: str) -> DataFrame:
    """vec_id and v (array of double) of the rows whose vector is complete and finite."""
    rows = df.select(df[vec].alias("vec_id"), df[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))


def _integers(lists: pa.Array, k: int, scale: int, shift: int) -> np.ndarray:
    values = np.asarray(lists.flatten(), dtype=float).reshape(-1, k)
    return np.clip(np.floor(scale * values) + shift, -_MOST, _MOST).astype(np.int64)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all usable vectors of ``df``; None where there is none."""
    rows = usable(df, vector, vector).select("v")
    frequent = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
    if frequent is None:
        return None
    k = frequent.k
    if k > MAX_DIMENSION:
        raise ValueError(f"{k} dimensions: the k x k matrix would not fit the driver")

    def decode(batch):
        return _integers(batch.column(0), k, scale, shift)

    n, sums, scatter = moments(rows.where(F.size("v") == k), k, decode)
    covariance = scatter / n
    values, vectors = components_of(covariance, min(components, k))
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)), scale, shift)


def apply(df: DataFrame, model: Whitening | None, vector: str = "embedding", vec: str = "vec_id") -> DataFrame:
    """vec_id, deviation (exact squared distance from the mean, times n squared) and whitened (array of double) of the usable rows."""
    rows = usable(df, vector, vec)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation bigint, whitened array<double>"
    if model is None:
        return rows.where(F.lit(False)).select("vec_id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    k, n, sums, scale, shift = model.dimension, model.n, model.sums, model.scale, model.shift
    varies = model.varies()
    axes = np.where(varies, model.components / np.sqrt(np.where(varies, model.values, 1.0)), 0.0)
    shared = df.sparkSession.sparkContext.broadcast(axes)  # dimension x components doubles
    # n * x - S in 64-bit integers where that is sure to hold it, else in whole numbers of any size
    limit = (2**62 - max(abs(s) for s in sums)) // n

    def run(batches):
        for batch in batches:
            x = _integers(batch.column(1), k, scale, shift)
            small = not len(x) or max(int(x.max()), -int(x.min())) <= limit
            if small:
                apart = x * np.int64(n) - np.array(sums, np.int64)
                centred = apart.astype(float) / n
                fits = np.abs(apart.astype(float)).max(1, initial=0.0) <= 2.0**31 * (2**0.5) / k**0.5
                total = (np.where(fits[:, None], apart, 0) ** 2).sum(1).tolist()
                for row in np.flatnonzero(~fits).tolist():
                    total[row] = sum(d * d for d in apart[row].tolist())
            else:
                whole = [[n * c - s for c, s in zip(row, sums)] for row in x.tolist()]
                centred = np.array([[d / n for d in row] for row in whole])
                total = [sum(d * d for d in row) for row in whole]
            deviation = pa.array([d if d < 2**63 else None for d in total], pa.int64())
            white = centred @ shared.value
            flat = pa.array(white.ravel(), mask=np.tile(~varies, len(white)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * len(varies)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return rows.where(F.size("v") == k).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, model: Whitening | None) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the components that vary."""
    if model is None or not model.varies().any():
        return None
    kept = int(model.varies().sum())

    def decode(batch):
        return np.asarray(batch.column(0).flatten(), dtype=float).reshape(batch.num_rows, -1)[:, :kept]

    n, _, scatter = moments(whitened.select("whitened"), kept, decode)
    return float(np.abs(scatter / n - np.eye(kept)).max())
