"""Reproducible pseudo-random numbers derived from row keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def hash60(*parts: Column | str | int) -> Column:
    """60-bit integer from the md5 of the parts joined with ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash120(*parts: Column | str | int) -> Column:
    """120-bit integer (as a decimal) from the md5 of the parts joined with ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    digest = F.md5(text.cast("binary"))
    half = HASH_BITS // 4
    high, low = (
        F.conv(F.substring(digest, at, half), 16, 10).cast("decimal(38,0)") for at in (1, 1 + half)
    )
    return (high * F.lit(Decimal(2**HASH_BITS)) + low).cast("decimal(38,0)")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1) from :func:`hash60`."""
    return hash60(*parts) / F.lit(float(2**HASH_BITS))
