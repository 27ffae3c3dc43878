"""Exact quantiles without a global sort.

A mergeable sketch of bounded size brackets a rank between two values of the table; one
filtered pass counts what lies below and at the two ends.  The rank is one of the ends, or the
search goes on between them, where only a small share of the rows is left.  The last few
thousand different values come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sketch is off by at most n / ACCURACY ranks.
ACCURACY = 10_000
#: Different values that are fetched and counted in the end.
FETCHED = 5_000


def _value_at(rows: DataFrame, rank: int, n: int, accuracy: int, fetched: int) -> float:
    """The value of a 0-based ascending rank of column ``x``: neither null nor NaN."""
    x, width = F.col("x"), 2
    while n > fetched:
        share = (rank + 0.5) / n
        ends = [max(0.0, share - width / accuracy), min(1.0, share + width / accuracy)]
        low, high = rows.agg(F.percentile_approx(x, ends, accuracy)).first()[0]
        inside = (x > low) & (x < high)
        below, at_low, between, at_high = rows.agg(
            *[F.count(F.when(c, 1)) for c in (x < low, x == low, inside, (x == high) & (x > low))]
        ).first()
        rank_here = rank - below
        if rank_here < 0 or rank_here >= at_low + between + at_high:
            width *= 4  # beside the bracket: a wider one
            continue
        if rank_here < at_low:
            return low
        if rank_here >= at_low + between:
            return high
        rows, rank, n = rows.where(inside), rank_here - at_low, between
    for r in sorted(rows.groupBy("x").count().collect(), key=lambda r: r["x"]):
        rank -= r["count"]
        if rank < 0:
            return r["x"]
    raise RuntimeError("the table changed between two passes")


def quantile(
    df: DataFrame,
    column: str,
    fraction: float,
    approximate: bool = False,
    accuracy: int = ACCURACY,
    fetched: int = FETCHED,
) -> float | None:
    """Quantile with linear interpolation between the two nearest ranks; None without a value.

    Nulls are left out; NaN is larger than any number.  ``approximate`` gives the sketch's
    value instead, off by at most 1 / ``accuracy`` of the rows, in one pass.  Each other
    call takes two passes a round and a few rounds; write ``df`` first if it is costly.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be 0 to 1")
    rows = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    if approximate:
        return rows.agg(F.percentile_approx("x", fraction, accuracy)).first()[0]
    n, numbers = rows.agg(F.count("x"), F.count(F.when(~F.isnan("x"), 1))).first()
    if not n:
        return None
    at = fraction * (n - 1)
    rank = math.floor(at)
    if rank >= numbers:
        return math.nan
    finite = rows.where(~F.isnan("x"))
    value = _value_at(finite, rank, numbers, accuracy, fetched)
    if at == rank:
        return value
    upto, after = finite.agg(
        F.count(F.when(F.col("x") <= value, 1)), F.min(F.when(F.col("x") > value, F.col("x")))
    ).first()
    if upto > rank + 1:
        after = value
    elif after is None:
        after = math.nan
    return value + (after - value) * (at - rank)
