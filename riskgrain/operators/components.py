"""The largest principal components by block subspace iteration.

Rows stay where they are: a pass multiplies every row with a block of ``k`` plus a few directions and sums what comes
back, ``columns x block`` numbers; no covariance matrix is formed.  The directions of all passes
span the space in which the components are sought (Rayleigh-Ritz), which needs far fewer passes than the last block
alone.  The driver holds ``columns x block`` numbers for each pass and orthonormalises them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import literal

#: Directions beyond those asked for.
SPARE = 10
#: A component has settled when what is left of it is this share of the largest one.
TOLERANCE = 1e-7
PASSES = 30
#: Numbers of a batch that are multiplied at once.
VALUES = 1 << 20


def _dense(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, None]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
    return x.reshape(-1, width), None


def _times(batch: pa.RecordBatch, width: int, sparse: bool, q: np.ndarray) -> np.ndarray:
    """``X' (X q)`` of a batch's rows."""
    if not sparse:
        x, _ = _dense(batch, width)
        return x.T @ (x @ q)
    column = batch.column("x")
    where, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(batch)), sizes)
    out = np.zeros((width, q.shape[1]))
    for c in range(q.shape[1]):
        y = np.bincount(row, q[where, c], len(batch))
        out[:, c] = np.bincount(where, y[row], width)
    return out


def _sums(rows: DataFrame, size: int, width: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of arrays of ``size`` numbers."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            some = max(1, VALUES // max(1, width))
            for start in range(0, len(batch), some):
                total += part(batch.slice(start, some)).ravel()
        at = np.flatnonzero(total)
        yield pa.record_batch({"i": pa.array(at), "v": pa.array(total[at])})

    summed = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for batch in summed.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def principal_components(
    df: DataFrame, column: str, k: int, width: int | None = None, sparse: bool = False, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Variances (largest first), directions as columns, and the total variance.

    ``column`` is an array of ``width`` numbers, or with ``sparse`` the array of
    the positions of a row's ones.  Rows where it is null are left out; a missing number counts as 0.
    """
    rows = df.select(F.col(column).alias("x")).where("x IS NOT NULL")
    if width is None:
        width = (rows.select(F.size("x").alias("n")).first() or [0])[0]
    if sparse:
        rows = rows.select(F.col("x").cast("array<int>").alias("x"))
    else:
        rows = rows.select(F.transform("x", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("x"))

    def moments(batch):
        if sparse:
            ones = np.bincount(batch.column("x").flatten().to_numpy(zero_copy_only=False), minlength=width)
            return np.concatenate([[len(batch)], ones, ones])
        x, _ = _dense(batch, width)
        return np.concatenate([[len(batch)], x.sum(axis=0), (x * x).sum(axis=0)])

    first = _sums(rows, 2 * width + 1, width, moments)
    n, mean = first[0], first[1:width + 1] / max(first[0], 1)
    total = float((first[width + 1:] - n * mean * mean).sum() / max(n - 1, 1))
    k, block = min(k, width), min(width, k + SPARE)
    if n < 2 or k < 1:
        return np.zeros(k), np.zeros((width, k)), 0.0

    def covariance(q: np.ndarray) -> np.ndarray:
        product = _sums(rows, width * q.shape[1], width, lambda batch: _times(batch, width, sparse, q)).reshape(width, -1)
        return (product - n * np.outer(mean, mean @ q)) / (n - 1)

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))[0]
    basis, images = np.empty((width, 0)), np.empty((width, 0))
    while True:
        basis, images = np.hstack([basis, q]), np.hstack([images, covariance(q)])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        left = np.linalg.norm(images @ turn - basis @ turn * values, axis=0)
        if (left <= tolerance * max(values[0], 1e-300)).all() or basis.shape[1] >= width or images.shape[1] >= passes * block:
            return np.maximum(values, 0), basis @ turn, total
        fresh = images[:, -q.shape[1]:]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        # directions that the space has already are not new
        u, s, _ = np.linalg.svd(fresh, full_matrices=False)
        q = u[:, s > 1e-10 * max(values[0], 1e-300)][:, :width - basis.shape[1]]
        if not q.shape[1]:
            return np.maximum(values, 0), basis @ turn, total
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]


def component_variance(df: DataFrame, column: str, k: int, **options) -> DataFrame:
    """``(component, variance_ratio)`` of the ``k`` largest components."""
    values, _, total = principal_components(df, column, k, **options)
    rows = [(i + 1, float(v / total) if total > 0 else None) for i, v in enumerate(values)]
    return literal(df.sparkSession, rows, "component int, variance_ratio double")
