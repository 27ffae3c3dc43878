"""What the vector operators share: which vectors take part, and their packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """False for vectors that are null, empty, zero or hold null or non-finite components."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    gauss = np.random.default_rng([seed, dim]).standard_normal((dim, dim))
    q, r = np.linalg.qr(gauss)
    return q * np.sign(np.diag(r))


def norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow or underflow of the squares."""
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))
