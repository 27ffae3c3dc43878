"""Score items and normalise the scores over a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import score as S
from gradus.operators.exact import exact_moments
from gradus.storage import materialise


def raw_score_column(zero_markers: Sequence[str] = S.ZERO_MARKERS) -> Column:
    return S.raw_log_score(
        F.col("logical_expressions"),
        F.col("predicates"),
        F.col("constants"),
        F.col("option_analysis"),
        zero_markers,
    )


def with_raw_score(df: DataFrame, zero_markers: Sequence[str] = S.ZERO_MARKERS) -> DataFrame:
    """Add ``score_log``; row-local, no shuffle."""
    return df.withColumn("score_log", raw_score_column(zero_markers))


def score_stats(df: DataFrame, group_cols: Sequence[str] = (), score: str = "score_log") -> DataFrame:
    """Mean and population variance of the raw scores, per group if asked.

    Both are summed exactly, so they and the scores normalised with them are the same
    however the rows are partitioned.
    """
    return exact_moments(df, score, group_cols)


def normalise(
    df: DataFrame,
    stats: DataFrame | None = None,
    group_cols: Sequence[str] = (),
    score: str = "score_log",
    epsilon: float = S.EPSILON,
    gamma: float = S.GAMMA,
    beta: float = S.BETA,
) -> DataFrame:
    """Add ``score_norm``.

    The statistics are one row, read as a scalar subquery, or one row per group,
    joined on the group.  Give ``stats`` to reuse frozen statistics.
    """
    stats = score_stats(df, group_cols, score) if stats is None else stats

    def norm(mean: Column, variance: Column) -> Column:
        return S.layernorm_sigmoid(F.col(score), mean, variance, epsilon, gamma, beta)

    if not group_cols:
        one = stats.select(F.struct("mean", "variance").alias("s")).scalar()
        return (
            df.withColumn("_s", one)
            .withColumn("score_norm", norm(F.col("_s.mean"), F.col("_s.variance")))
            .drop("_s")
        )
    renamed = stats.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)],
        F.col("mean").alias("_mean"),
        F.col("variance").alias("_variance"),
    )
    condition = F.lit(True)
    for i, c in enumerate(group_cols):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (
        df.join(renamed, condition, "left")
        .withColumn("score_norm", norm(F.col("_mean"), F.col("_variance")))
        .select(*[F.col(f"`{c}`") for c in df.columns], "score_norm")
    )


def score_items(
    df: DataFrame,
    group_cols: Sequence[str] = (),
    stats: DataFrame | None = None,
    zero_markers: Sequence[str] = S.ZERO_MARKERS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``score_log`` and ``score_norm`` to every item.

    The score expression is costly and normalising needs it twice, so the raw
    scores are written once to the shared folder, with the columns in ``keep``
    (all by default; pass the key columns when only scores are needed).  With
    frozen ``stats`` there is one pass and nothing is written.
    """
    raw = with_raw_score(df, zero_markers)
    if keep is not None:
        raw = raw.select(*dict.fromkeys([*keep, *group_cols]), "score_log")
    if stats is None:
        raw = materialise(raw, "raw-scores")
    return normalise(raw, stats, group_cols)
