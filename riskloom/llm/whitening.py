"""Embedding whitening from spectral divide and conquer on QDWH polar decompositions.

The covariance V of the vectors is split at a shift s: the orthogonal polar factor U of V - s I has the
eigenvalue 1 where those of V lie above s and -1 below, so (U + I) / 2 projects on the invariant subspace above
and (I - U) / 2 on the one below. V restricted to each is split again until single components are left. The
polar factor comes from the dynamically weighted Halley iteration (QDWH): by QR while the iterate is badly
conditioned, by Cholesky afterwards; six steps are enough in double precision.

Spark does what grows with the data, in passes over the vectors: exact sums, the covariance about the mean,
the covariance of the whitened vectors, and the projection itself. Tasks add up what they read and hand on one
matrix row per dimension. The matrix that is split has the size of a vector's length squared, whatever the
number of vectors; so have the components that are told to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import long_lists

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Integers are held within this, which only entries above some 10**15 reach.
_MOST = 2**61
_EPS = np.finfo(np.float64).eps
#: Eigenvalues below this part of the largest are rounding errors, not directions of the data.
LEAST_PART = 1e-12
_ROWS = 8192


# The matrix part ------------------------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH."""
    n = len(a)
    size = np.linalg.norm(a)
    if size == 0:
        return np.zeros_like(a)
    x, low = a / size, _EPS / 2  # no singular value that counts is below this
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > 100:
            both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
            x = (q / r) * x + (p - q / r) / np.sqrt(r) * (both[:n] @ both[n:].T)
        else:
            lower = np.linalg.cholesky(np.eye(n) + r * (x.T @ x))
            solved = np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
            x = (q / r) * x + (p - q / r) * solved
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if 1 - low < 10 * _EPS and np.linalg.norm(x - before) <= np.cbrt(_EPS) * np.sqrt(n):
            break
    return x


def _bases(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift that parts the eigenvalues."""
    n = len(a)
    diagonal = np.diag(a)
    middle, mean = float(np.median(diagonal)), float(diagonal.mean())
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    # Mean and middle lie within the eigenvalues' range; the others serve where a shift meets an eigenvalue.
    shifts = [middle, mean, *[mean + part * spread for part in (0.11, -0.13, 0.29, -0.31, 0.53, -0.57, 0.83, -0.89)]]
    start = np.random.default_rng(n).standard_normal((n, n))
    best = None
    for shift in shifts:
        u = polar_factor(a - shift * np.eye(n))
        above = (u + np.eye(n)) / 2
        k = int(round(float(np.trace(above))))
        if not 0 < k < n:
            continue
        below = np.eye(n) - above
        one, _ = np.linalg.qr(above @ start[:, :k])
        two, _ = np.linalg.qr(below @ start[:, k:])
        one, _ = np.linalg.qr(above @ one)
        two, _ = np.linalg.qr(below @ two - one @ (one.T @ (below @ two)))
        left = np.linalg.norm(one.T @ a @ two)
        if best is None or left < best[0]:
            best = left, one, two
        if left <= 64 * _EPS * np.linalg.norm(a):
            break
    return None if best is None else best[1:]


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    scale = np.linalg.norm(a)

    def split(part: np.ndarray, basis: np.ndarray) -> list[tuple[float, np.ndarray]]:
        n = len(part)
        off = np.linalg.norm(part - np.diag(np.diag(part)))
        found = None if n == 1 or off <= 4 * _EPS * scale else _bases(part)
        if found is None:  # diagonal: equal eigenvalues are equal to rounding
            return [(float(part[i, i]), basis[:, i]) for i in range(n)]
        out = []
        for side in found:
            inner = side.T @ part @ side
            out += split((inner + inner.T) / 2, basis @ side)
        return out

    parts = split((a + a.T) / 2, np.eye(len(a)))
    parts.sort(key=lambda p: -p[0])
    vectors = np.array([v / np.linalg.norm(v) for _, v in parts]).T
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(parts))])
    return np.array([e for e, _ in parts]), vectors * signs


# The passes over the vectors ------------------------------------------------------------------------------


@dataclass
class _Fit:
    """What tasks know about the vectors of one length."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None  # one column each, divided by the root of its eigenvalue
    explained: np.ndarray | None = None
    error: float = 0.0

    def __post_init__(self) -> None:
        self.floor = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)**2, null where one does not fit a long. Products wrap; such a sum does not."""
        wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], dtype=np.int64)
        apart = x * np.int64(self.n) - wrapped
        exact = (apart * apart).sum(axis=1)
        about = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        return [int(v) if near < 9.2e18 else None for v, near in zip(exact, about, strict=True)]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_id, integer vectors) of usable rows, those of one length at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            batch = batch.filter(batch.column(1).is_valid())
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            ends = np.cumsum(lengths)
            for length in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == length)
                vectors = flat[(ends[rows] - length)[:, None] + np.arange(length)]
                finite = np.isfinite(vectors).all(axis=1)
                if not finite.any():
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(SCALE * vectors[finite]), -_MOST, _MOST).astype(np.int64) + SHIFT
                yield batch.column(0).take(pa.array(rows[finite])), x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """length, i (-1: the number of vectors) and the exact sum of a task's vectors."""
    totals: dict[tuple[int, int], int] = {}
    for _, x in _usable(batches):
        length = x.shape[1]
        high, low = (x >> 32).sum(axis=0).tolist(), (x & (2**32 - 1)).sum(axis=0).tolist()
        for i, (h, w) in enumerate(zip(high, low, strict=True)):
            totals[length, i] = totals.get((length, i), 0) + h * 2**32 + w
        totals[length, -1] = totals.get((length, -1), 0) + len(x)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in totals], pa.int32()),
            pa.array([k[1] for k in totals], pa.int32()),
            pa.array(list(totals.values()), pa.decimal128(38, 0)),
        ],
        names=["length", "i", "total"],
    )


def _matrix_rows(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    keys = [(length, i) for length, m in totals.items() for i in range(len(m))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int32()),
            long_lists([totals[length][i] for length, i in keys], pa.float64()) if keys else pa.array([], pa.list_(pa.float64())),
        ],
        names=["length", "i", "row"],
    )


def _products(fits, whitened: bool):
    """Rows of a task's sum of outer products: of centred vectors, or of a leading 1 and the whitened ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for _, x in _usable(batches):
            fit = fits.value[x.shape[1]]
            if whitened:
                if not fit.components.shape[1]:
                    continue
                z = np.hstack([np.ones((len(x), 1)), fit.whitened(x)])
            else:
                z = fit.centred(x)
            part = z.T @ z
            totals[x.shape[1]] = totals[x.shape[1]] + part if x.shape[1] in totals else part
        yield _matrix_rows(totals)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one place added up."""
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        rows = batch.column(2)
        for length, i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows, strict=True):
            own = row.values.to_numpy()
            totals[length, i] = totals[length, i] + own if (length, i) in totals else own
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in totals], pa.int32()),
            pa.array([k[1] for k in totals], pa.int32()),
            long_lists(list(totals.values()), pa.float64()) if totals else pa.array([], pa.list_(pa.float64())),
        ],
        names=["length", "i", "row"],
    )


def _matrices(vectors: DataFrame, fits, whitened: bool) -> dict[int, np.ndarray]:
    """The summed matrix of each length: as many rows as a vector has entries come to the driver."""
    schema = "length int, i int, row array<double>"
    parts = vectors.mapInArrow(_products(fits, whitened), schema).repartition("length", "i")
    rows = sorted(parts.mapInArrow(_added, schema).collect(), key=lambda r: (r.length, r.i))
    out: dict[int, list] = {}
    for row in rows:
        out.setdefault(row.length, []).append(row.row)
    return {length: np.array(m) for length, m in out.items()}


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, _Fit]:
    """The fit of every vector length of a table (vec_id, embedding)."""
    spark = vectors.sparkSession
    told = vectors.mapInArrow(_sums, "length int, i int, total decimal(38,0)").groupBy("length", "i")
    totals = {(r.length, r.i): int(r.total) for r in told.agg(F.sum("total").alias("total")).collect()}
    fits = {
        length: _Fit(n, [totals[length, i] for i in range(length)]) for (length, k), n in totals.items() if k == -1
    }
    if not fits:
        return {}
    held = spark.sparkContext.broadcast(fits)
    for length, total in _matrices(vectors, held, whitened=False).items():
        fit = fits[length]
        values, axes = spectral_components(total / fit.n)
        trace = float(np.trace(total)) / fit.n
        most = min(components, int((values > max(LEAST_PART * values[0], 0)).sum()))
        fit.components = axes[:, :most] / np.sqrt(values[:most])
        fit.explained = values[:most] / trace if most else np.zeros(0)
    held = spark.sparkContext.broadcast(fits)
    for length, total in _matrices(vectors, held, whitened=True).items():
        mean = total[0, 1:] / total[0, 0]
        covariance = total[1:, 1:] / total[0, 0] - np.outer(mean, mean)
        fits[length].error = float(np.abs(covariance - np.eye(len(mean))).max())
    return fits


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error per usable row and component.

    A row whose vector is null or holds a null or non-finite entry has no result. Vectors of each length are
    whitened on their own; n counts those of the row's length. Directions without variance (equal rows, fewer
    rows than dimensions, empty vectors) are no components, so one lone vector has none. Entries beyond some
    10**15 count as that; a deviation that a long cannot hold is null. Repeated and null vec_ids each get their
    rows; other columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    held = spark.sparkContext.broadcast(fit_whitening(vectors, components))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _usable(batches):
            fit = held.value[x.shape[1]]
            k = fit.components.shape[1]
            if not k:
                continue
            rows = np.repeat(np.arange(len(x)), k)
            deviations = pa.array(fit.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), fit.n, dtype=np.int64)),
                    deviations.take(pa.array(rows)),
                    pa.array(fit.whitened(x).ravel()),
                    pa.array(np.tile(fit.explained, len(x))),
                    pa.array(np.full(len(rows), fit.error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(
        project,
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
