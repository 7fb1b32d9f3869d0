"""Leading singular vectors of feature rows, not centred, by subspace iteration over blocks.

A pass multiplies a few columns, as long as the features, by the rows and by the
rows transposed, and sums up; the columns are made orthogonal and rotated to the
directions found so far. Nothing of the width squared is ever made.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .blocks import Rows, summed

#: Columns besides the wanted ones; they make the wanted ones converge sooner.
EXTRA = 8


def leading_vectors(df: DataFrame, width: int, wanted: int, tol: float = 1e-5, most: int = 40, seed: int = 42) -> np.ndarray:
    """Right singular vectors (width, wanted) with residuals of at most tol times the squared singular values, in most passes."""
    size = min(wanted + EXTRA, width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    for _ in range(most):

        def task(found: Iterable[tuple[int, Rows]], q: np.ndarray = q) -> np.ndarray:
            return sum((rows.transposed_times(rows.times(q)) for _, block in found for rows in block.slices()), np.zeros(q.shape))

        z = summed(df, task, q.size).reshape(width, size)
        values, turn = np.linalg.eigh(q.T @ z)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        rest = np.linalg.norm(z - q * values, axis=0)[:wanted]
        if (rest <= tol * np.maximum(np.abs(values[:wanted]), 1e-300)).all():
            break
        q = np.linalg.qr(z)[0]
    return q[:, :wanted]
