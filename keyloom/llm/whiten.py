"""Embedding whitening: exact integer sums, centred scatters merged by Chan's formula, principal components scaled to variance one.

Three passes over the vectors. The first gives a partial of each partition: count, local mean, centred scatter and the exact sums; ``treeReduce`` merges partials pairwise, and the driver
finds the eigenvectors of one matrix of the vectors' dimension. The second merges the scatter of the whitened vectors the same way, which shows how far their covariance is from the identity.
The third writes the rows. Only the model, which is as large as the dimension squared at most, is on the driver or sent to executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .vectors import finite, matrix, usual_dimension

COMPONENTS = 8
#: Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Eigenvalues below this share of the largest, for each dimension, are rounding noise: such components have no variance to divide by.
_RANK = 1e-15
_LONG = 2**63 - 1


class Partial(NamedTuple):
    """Rows seen so far: their number, mean, centred scatter, and exact sums as Python integers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]


def partial(x: np.ndarray) -> Partial:
    if not len(x):
        return Partial(0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2), [0] * x.shape[1])
    mean = x.mean(0)
    mean += (x - mean).mean(0)  # the mean of large numbers, to the last digits
    y = x - mean
    return Partial(len(x), mean, y.T @ y, [])


def merge(a: Partial, b: Partial) -> Partial:
    """Chan's pairwise formula: the scatter between the two means is added to those around them."""
    if not a.n or not b.n:
        return b if not a.n else a
    n, gap = a.n + b.n, b.mean - a.mean
    sums = [p + q for p, q in zip(a.sums, b.sums, strict=True)]
    return Partial(n, a.mean + gap * (b.n / n), a.scatter + b.scatter + np.outer(gap, gap) * (a.n * (b.n / n)), sums)


class Model(NamedTuple):
    """What whitens a vector: ``basis`` holds unit eigenvectors as columns, by falling eigenvalue; ``scale`` is one over the root of the eigenvalue, nan where there is no variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    basis: np.ndarray
    scale: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis * self.scale


def fit(total: Partial, components: int) -> Model:
    """The model of all rows; of an eigenvector and its negative, the one whose largest entry is positive."""
    values, vectors = np.linalg.eigh(total.scatter / max(total.n, 1))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k = min(components, len(values))
    basis, e, trace = vectors[:, :k], values[:k], float(np.trace(total.scatter)) / max(total.n, 1)
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    sound = e > _RANK * len(values) * max(values[0], np.finfo(float).tiny)
    scale = np.where(sound, 1 / np.sqrt(np.where(sound, e, 1.0)), np.nan)
    mean = np.array([s / total.n for s in total.sums]) if total.n else total.mean
    return Model(total.n, total.sums, mean, basis, scale, e / trace if trace > 0 else np.zeros(k))


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x) + SHIFT


def _reduced(rows: DataFrame, dimension: int, of: Callable[[np.ndarray], np.ndarray], exact: bool) -> Partial:
    """The partial of ``of`` all rows' matrices, with exact sums if these hold whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            x = of(matrix(b.column(0), dimension))
            one = partial(x)
            one = one._replace(sums=_exact_sums(x) if exact else [0] * x.shape[1])
            done = one if done is None else merge(done, one)
        if done is not None:
            yield pa.RecordBatch.from_pydict({"n": [done.n], "mean": [done.mean.tobytes()], "scatter": [done.scatter.tobytes()], "sums": [",".join(map(str, done.sums))]})

    def read(r) -> Partial:
        mean = np.frombuffer(r["mean"])
        return Partial(r["n"], mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1), [int(s) for s in r["sums"].split(",")])

    parts = rows.select("x").mapInArrow(run, "n long, mean binary, scatter binary, sums string").rdd.map(read)
    return parts.treeReduce(merge)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns of whole numbers, in integers."""
    if np.abs(x).max(initial=0) * len(x) < _LONG // 2:
        return x.astype(np.int64).sum(0).tolist()
    return [sum(map(int, c)) for c in x.T.tolist()]


def _deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """For each row the sum over dimensions of (n * x - sum)^2, exactly; None where it doesn't fit a long."""
    low, high = np.array(model.sums, dtype=object), x.astype(object)
    largest = max(max(map(abs, model.sums)), int(np.abs(x).max(initial=0)) * model.n)
    if largest < _LONG // 2:
        y = np.abs(x.astype(np.int64) * model.n - np.array(model.sums, np.int64))
        if len(y) and int(y.max()) <= math.isqrt(_LONG // y.shape[1]):
            return (y * y).sum(1).tolist()
    exact = [sum((model.n * int(v) - s) ** 2 for v, s in zip(row, low, strict=True)) for row in high]
    return [v if v <= _LONG else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component of ``vectors`` (vec_id, embedding): vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    The model is fitted to all vectors that remain: not those that are null or empty, or hold null or non-finite entries (or such as overflow when scaled), nor those whose length isn't the most frequent one. There are as many
    components as dimensions at most. A component without variance (as with one row, or equal rows) has null ``whitened``, and isn't part of ``identity_error``, which is null if none has any.
    ``deviation`` is null where it doesn't fit a long. Repeated rows count and come out repeatedly; a null vec_id comes out null; other columns are left out. An empty table gives no rows.
    """
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(finite(F.col("x"), SCALE))
    dimension = usual_dimension(rows, "x")
    if dimension is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == dimension)
    model = fit(_reduced(rows, dimension, whole, True), components)
    sound = np.flatnonzero(~np.isnan(model.scale))
    error = None
    if len(sound):
        again = _reduced(rows, dimension, lambda x: model.whitened(whole(x))[:, sound], False)
        error = float(np.abs(again.scatter / again.n - np.eye(len(sound))).max())
    k = len(model.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(matrix(b.column(1), dimension))
            m, y = len(x), model.whitened(x).ravel()
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n)),
                "deviation": pa.array(_deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                "whitened": pa.array(y, mask=np.isnan(y)),
                "explained": pa.array(np.tile(model.explained, m)),
                "identity_error": pa.array([error] * (m * k), pa.float64()),
            })

    return rows.mapInArrow(run, schema)


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
