"""The number of tables by length."""

import math

import numpy as np
import pytest

from gradus.llm.binary_codes import bucket_keys, tables_for


@pytest.mark.parametrize("dim", [64, 384])
def test_tables_hold_the_stated_miss(dim):
    """Agreement measured with the hashes themselves."""
    rng = np.random.default_rng(9)
    x, y = rng.standard_normal((2, 3000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    agree = (bucket_keys(x, 1, 4, 3) == bucket_keys(y, 1, 4, 3)).mean()
    assert (1 - agree) ** tables_for(dim, 1, 0.98, 1e-9) < 3e-9 < (1 - agree) ** 14
