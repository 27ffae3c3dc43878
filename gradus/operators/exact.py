"""Mean and variance that do not depend on how the rows are partitioned.

A double is a whole number times a power of two.  The whole numbers are added up by
exponent in decimals, without rounding, and so are their squares, in halves; the few sums of a
group are put together as fractions and rounded once.  Any order of any partitions therefore
gives the same bits, and these are the doubles nearest to the true values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the lower half of a whole number; the upper half has no more than 27.
HALF = 28
#: Digits of the sums: 10^21 rows of one exponent do not overflow them.
SUM = "decimal(38,0)"

_MOMENTS = "mean double, variance double"


def _parts(value: Column) -> tuple[Column, Column]:
    """(m, e) with value = m * 2^e exactly and m below 2^55, for a finite value.

    The logarithm may be off by one at a power of two; the spare bits allow for it.
    Powers of two are exact, and the scaling is done in two steps since 2^-e may exceed
    the range of a double.
    """
    e = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(value))).cast("int") - 53)
    up = F.floor(-e / 2)
    scaled = value * F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), -e - up)
    return scaled.cast("bigint"), e


def _rounded(value: Fraction) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _moments(sums: list | None) -> tuple[float | None, float | None]:
    """Mean and population variance from the sums of each exponent."""
    if sums is None or not len(sums):
        return None, None
    n, first, second = 0, Fraction(0), Fraction(0)
    for s in sums:
        n += s["n"]
        first += int(s["m"]) * Fraction(2) ** s["e"]
        square = (int(s["hh"]) << 2 * HALF) + (int(s["hl"]) << HALF + 1) + int(s["ll"])
        second += square * Fraction(4) ** s["e"]
    return _rounded(first / n), _rounded(second / n - (first / n) ** 2)


def _moments_column(sums: Column) -> Column:
    @F.pandas_udf(_MOMENTS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for groups in batches:
            found = [_moments(g) for g in groups]
            yield pd.DataFrame(found, columns=["mean", "variance"]).astype("float64")

    return of(sums)


def exact_moments(df: DataFrame, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group columns, mean, variance): the doubles nearest to the exact mean and population variance.

    Nulls are left out; a group of nulls only, and an empty table without groups, gives
    nulls.  A NaN, or infinities of both signs, gives NaN; infinities of one sign that
    infinity.  Two aggregations: a row per exponent and group (at most some 2,100 a group) from
    each task, then one per group.  Without groups these few rows come to the driver when the
    frame is built, and its one row is a constant.
    """
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)]
    names = [f"_g{i}" for i in range(len(group_cols))]
    x = F.col("_x")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    m, e = _parts(x)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"))
    rows = rows.select(*names, F.when(odd, x).alias("_special"), F.when(~odd, x).alias("_x"))
    rows = rows.select(*names, "_special", m.alias("_m"), e.alias("_e"))
    high = F.shiftright("_m", HALF)
    low = F.col("_m").bitwiseAND((1 << HALF) - 1)

    def total(term: Column) -> Column:
        return F.sum(term.cast("decimal(18,0)")).cast(SUM)

    by_exponent = rows.groupBy(*names, "_e").agg(
        F.count("_m").alias("n"),
        total(F.col("_m")).alias("m"),
        total(high * high).alias("hh"),
        total(high * low).alias("hl"),
        total(low * low).alias("ll"),
        # The sum of what is not finite says which kind it is.
        F.sum("_special").alias("_special"),
    )
    by_exponent = by_exponent.withColumnRenamed("_e", "e")
    if not names:
        found = by_exponent.collect()
        specials = [r["_special"] for r in found if r["_special"] is not None]
        mean, variance = _moments([r for r in found if r["e"] is not None])
        if specials:
            mean, variance = sum(specials), math.nan
        return df.sparkSession.range(0, 1, 1, 1).select(
            F.lit(mean).cast("double").alias("mean"), F.lit(variance).cast("double").alias("variance")
        )
    terms = F.struct("n", "e", "m", "hh", "hl", "ll")
    grouped = by_exponent.groupBy(*names).agg(
        F.collect_list(F.when(F.col("e").isNotNull(), terms)).alias("_sums"),
        F.sum("_special").alias("_special"),
    )
    special = F.col("_special")
    return grouped.withColumn("_r", _moments_column(F.col("_sums"))).select(
        *[F.col(n).alias(c) for n, c in zip(names, group_cols)],
        F.coalesce(special, "_r.mean").alias("mean"),
        F.when(special.isNotNull(), float("nan")).otherwise(F.col("_r.variance")).alias("variance"),
    )
