"""Embedding whitening by the leading principal components.

Entries become integers (``floor(scale * entry)``); the model is fitted on the different
integer vectors, so copies weigh no more than one.  Three distributed passes over these give
their count and sums, the covariance (centred before multiplying) and, for the finished
model, how far the whitened covariance is from the identity.  In between the driver solves
the one small matrix: Householder reflections make it tridiagonal, bisection on Sturm counts
finds the leading eigenvalues, inverse iteration their vectors, made orthogonal again within
clusters of close eigenvalues.  The components travel to all tasks, which project their rows.

Scale: rows are folded to different vectors before the one shuffle, so a vector held by a
third of all rows crosses once a task; the folded integers are written once, in a few bits an
entry.  A task sends one number for each pair of dimensions, whatever its rows; the driver and
the broadcast hold numbers by dimension only (``d * d`` and ``k * d``), never by row.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are dropped.
Vectors of another length than the most frequent one (ties: the longer) have no place in the
space and are dropped too.  A component without variance (fewer different vectors than
components) whitens to 0.  No remaining rows, or vectors without entries, give no rows of
components.  Ids may be null or repeated; all other columns are carried, but for one named
like the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tramline.llm.common import stored

#: Rows that one numpy step takes.
BLOCK_ROWS = 4096
EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this share of the matrix norm are one cluster.
CLUSTER = 1e-3


# The small matrix, on the driver.

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors: ``matrix`` is H0 H1 .. T .. H1 H0 with H = I - 2 v v'."""
    a = np.array(matrix, float)
    n, reflectors = len(a), []
    for j in range(n - 2):
        below = a[j + 1 :, j]
        scale = np.abs(below[1:]).max()
        v = np.zeros(n)
        if scale > 0:
            # Scaled first: squares of very small entries would vanish.
            w = below / max(scale, abs(below[0]))
            w[0] += np.copysign(np.sqrt(w @ w), w[0])
            v[j + 1 :] = w / np.sqrt(w @ w)
            p = a @ v
            p -= (v @ p) * v
            a -= 2 * (np.outer(v, p) + np.outer(p, v))
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every point, how many eigenvalues of the tridiagonal matrix lie below it (Sturm)."""
    squares = np.concatenate([[0.0], off * off])
    least = max(float(squares.max()), 1.0) * np.finfo(float).tiny
    q, below = np.ones_like(at), np.zeros(len(at), int)
    for d, b in zip(diagonal, squares):
        q = d - at - b / q
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection to the last bits."""
    n = len(diagonal)
    radius = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    # Rank from below: the value with r eigenvalues below it.
    rank = n - 1 - np.arange(k)
    margin = 2 * EPS * n * float((np.abs(diagonal) + radius).max()) + np.finfo(float).tiny
    low = np.full(k, float((diagonal - radius).min()) - margin)
    high = np.full(k, float((diagonal + radius).max()) + margin)
    while True:
        middle = low + (high - low) / 2
        if not np.any((middle > low) & (middle < high)):
            return middle
        above = count_below(diagonal, off, middle) > rank
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solves (T - shift) x = y by elimination with row exchanges; tiny pivots count as ``least``."""
    n = len(diagonal)
    u, v, w = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    steps = []
    for i in range(n - 1):
        low, next_diagonal, next_off = off[i], u[i + 1], v[i + 1]
        swap = abs(low) > abs(u[i])
        if swap:
            factor = u[i] / low
            u[i], old_v, v[i], w[i] = low, v[i], next_diagonal, next_off
            u[i + 1], v[i + 1] = old_v - factor * next_diagonal, -factor * next_off
        else:
            u[i] = u[i] if abs(u[i]) > least else least
            factor = low / u[i]
            u[i + 1] = next_diagonal - factor * v[i]
        steps.append((swap, factor))
    u[-1] = u[-1] if abs(u[-1]) > least else least

    def solve(y: np.ndarray) -> np.ndarray:
        x = y.copy()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                x[i] -= v[i] * x[i + 1]
            if i + 2 < n:
                x[i] -= w[i] * x[i + 2]
            x[i] /= u[i]
        return x

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the falling ``values`` by inverse iteration."""
    n = len(diagonal)
    norm = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    found: list[np.ndarray] = []
    first, shift = 0, np.inf
    random = np.random.default_rng(n)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # Equal values get shifts a few bits apart, so that no two solves are the same.
        shift = min(value, shift - 4 * EPS * norm) if j > first else value
        solve = _solver(diagonal, off, shift, EPS * norm)
        x = random.uniform(-1, 1, n)
        for _ in range(6):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                for other in found[first:]:
                    x -= (other @ x) * other
            x /= np.sqrt(x @ x)
        found.append(x)
    return np.array(found).reshape(len(values), n)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    k = min(k, len(matrix))
    size = float(np.abs(matrix).max(initial=0))
    if not k or not size:
        return np.zeros(k), np.eye(k, len(matrix))
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, k)
    vectors = vectors_of(diagonal, off, values)
    for v in reversed(reflectors):
        vectors = vectors - 2 * np.outer(vectors @ v, v)
    return values * size, vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


# The rows, in tasks.

def integer_vector(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield _matrix(batch.column(0).slice(at, BLOCK_ROWS), dims)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Count and exact sums by dimension."""
    def run(batches):
        total = [0] * dims
        for x in _blocks(batches, dims):
            # Halves of 32 bits cannot pass 64 bits in a block.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low)]
        yield pa.record_batch({"i": pa.array(range(dims), pa.int32()), "s": pa.array(map(Decimal, total), pa.decimal128(38, 0))})

    found = fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = [0] * dims
    for row in found:
        sums[row["i"]] = int(row["s"])
    return fit.count(), sums


def _covariance(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    dims = len(mean)
    row, column = np.triu_indices(dims)

    def run(batches):
        total = np.zeros((dims, dims))
        for x in _blocks(batches, dims):
            y = x - mean
            total += y.T @ y
        yield pa.record_batch({"i": pa.array(row, pa.int32()), "j": pa.array(column, pa.int32()), "p": pa.array(total[row, column])})

    found = fit.mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toPandas()
    covariance = np.zeros((dims, dims))
    covariance[found["i"], found["j"]] = covariance[found["j"], found["i"]] = found["p"] / n
    return covariance


@dataclass(frozen=True)
class Whitening:
    """A fitted model; all but ``n`` and ``identity_error`` is by dimension or component."""

    scale: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace else 0.0 for v in self.values]

    def _projection(self):
        """From integer vectors (rows) to whitened values."""
        mean = np.array([s / max(1, self.n) for s in self.sums])
        # What rounding alone leaves is no variance.
        real = self.values > self.dims * EPS * max(self.trace, 0.0)
        weights = np.where(real, 1 / np.sqrt(np.where(real, self.values, 1.0)), 0.0)[:, None] * self.components
        return lambda x: (x - mean) @ weights.T

    def whitened(self, x: Column) -> Column:
        """``array<double>``, a value for each component, of an integer vector column."""
        project, dims = self._projection(), self.dims

        @arrow_udf("array<double>")
        def values(column: pa.Array) -> pa.Array:
            made = project(_matrix(column, dims))
            return pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * made.shape[1], pa.array(made.ravel()))

        return values(x)

    def deviation(self, x: Column) -> Column:
        """The exact sum over dimensions of ``(n * x - S)`` squared, as decimal(38,0)."""
        n, dims, sums = self.n, self.dims, list(self.sums)

        @arrow_udf("decimal(38,0)")
        def exact(column: pa.Array) -> pa.Array:
            rows = _matrix(column, dims)
            widest = n * float(np.abs(rows.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
            if dims * widest * widest < 2.0**62:
                y = n * rows - np.array(sums, np.int64)
                return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
            y = n * rows.astype(object) - np.array(sums, object)
            return pa.array([Decimal(int(v)) for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))

        return exact(x)

    def apply(self, rows: DataFrame, *, vector: str = "embedding", out: str = "white") -> DataFrame:
        """The usable rows with ``out``: struct of ``whitened`` (by component) and ``deviation``."""
        x = integer_vector(F.col(vector), self.scale)
        kept = rows.filter(usable(F.col(vector)) & (F.size(vector) == self.dims))
        others = [F.col(f"`{c}`") for c in rows.columns if c.lower() != out.lower()]
        return kept.select(*others, F.struct(self.whitened(x).alias("whitened"), self.deviation(x).alias("deviation")).alias(out))


def fit(rows: DataFrame, *, vector: str = "embedding", components: int = 4, scale: int = 256) -> Whitening:
    """Fits the model on the different integer vectors of the usable rows."""
    kept = rows.filter(usable(F.col(vector)))
    sizes = kept.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("rows"))
    common = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    dims = common["size"] if common else 0
    if not dims:
        return Whitening(scale, 0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    different = kept.filter(F.size(vector) == dims).select(integer_vector(F.col(vector), scale).alias("x")).distinct()
    different = stored(different, "vectors")
    n, sums = _sums(different, dims)
    covariance = _covariance(different, n, np.array([s / n for s in sums]))
    values, vectors = leading_components(covariance, components)
    model = Whitening(scale, n, tuple(sums), values, vectors, float(np.trace(covariance)))
    return Whitening(*[getattr(model, f) for f in ("scale", "n", "sums", "values", "components", "trace")], _identity_error(different, model))


def _identity_error(different: DataFrame, model: Whitening) -> float:
    """The largest entry by which the whitened vectors' covariance departs from the identity."""
    k = len(model.values)
    white = different.select(model.whitened(F.col("x")).alias("w")).select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max((abs(c - (i == j)) for (i, j), c in zip(pairs, found)), default=0.0)
