"""Histograms, balanced selection and error rates per score bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import bins as B
from gradus.functions.hashing import hash60
from gradus.functions.labels import error_flag
from gradus.storage import materialise

SELECT_SALTS = 32
#: Spark's setting: up to this rank a task drops rows before they are shuffled.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def _per_bin(
    df: DataFrame,
    value: Column,
    edges: Sequence[float],
    measures: dict[str, Column],
    by: Sequence[str] = (),
    closed: str = "left",
) -> DataFrame:
    """Sum of each measure per bin (and group), empty bins included.

    Every bin is a conditional sum of one aggregation, so each task sends one row
    per group and no bin table is joined.  Rows are filtered by their value, not
    by their bin: a filter on the bin would repeat the value once per edge.
    """
    n = len(edges) - 1
    binned = (
        df.select(*by, value.alias("_v"), *[m.alias(k) for k, m in measures.items()])
        .filter(B.in_range(F.col("_v"), edges))
        .select(*by, B.bin_number(F.col("_v"), edges, closed).alias("_bin"), *measures)
    )

    def total(name: str, i: int) -> Column:
        found = F.sum(F.when(F.col("_bin") == i, F.col(name)))
        return F.coalesce(found, F.lit(0)).alias(name)

    sums = F.array(*[F.struct(*[total(name, i) for name in measures]) for i in range(n)])
    per_bin = binned.groupBy(*by).agg(sums.alias("_sums"))
    return per_bin.select(*by, F.posexplode("_sums").alias("bin", "_m")).select(
        *by,
        "bin",
        B.edge_at(F.col("bin"), edges).alias("lower"),
        B.edge_at(F.col("bin") + 1, edges).alias("upper"),
        (F.col("bin") == n - 1).alias("closed_right"),
        "_m.*",
    )


def histogram(
    df: DataFrame,
    score: Column | str = "score_norm",
    edges: Sequence[float] = B.UNIFORM_EDGES,
    closed: str = "left",
    weight: Column | None = None,
) -> DataFrame:
    """Count per bin, empty bins included: (bin, lower, upper, closed_right, count)."""
    value = F.col(score) if isinstance(score, str) else score
    one = F.lit(1).cast("bigint") if weight is None else weight
    return _per_bin(df, value, edges, {"count": one}, closed=closed)


def histogram_by(
    df: DataFrame,
    by: Sequence[str],
    score: Column | str = "score_norm",
    edges: Sequence[float] = B.UNIFORM_EDGES,
) -> DataFrame:
    """Histogram per group with any valid score, empty bins included."""
    value = F.col(score) if isinstance(score, str) else score
    return _per_bin(df, value, edges, {"count": F.lit(1).cast("bigint")}, by)


def merge_histograms(df: DataFrame) -> DataFrame:
    """Sum counts by interval over any number of histograms, lowest first."""
    return (
        df.groupBy("lower", "upper", "closed_right")
        .agg(F.sum("count").alias("count"))
        .orderBy("lower")
    )


def histogram_from_midpoints(
    df: DataFrame, edges: Sequence[float] = B.UNIFORM_EDGES
) -> DataFrame:
    """Histogram again from the midpoint of each interval, weighted by its count.

    The edges are first cut to the two decimals the interval texts carry.
    """
    midpoint = (F.round("lower", 2) + F.round("upper", 2)) / 2
    return histogram(df, midpoint, edges, weight=F.col("count"))


def custom_bin(score: str = "score_norm") -> Column:
    """Bin of the two-decimal score in the 16 selection bins, for a valid score."""
    return B.bin_number(B.floor_2(F.col(score)), B.CUSTOM_EDGES)


def bin_counts(df: DataFrame, score: str = "score_norm") -> DataFrame:
    """Row count per selection bin, empty bins included."""
    return histogram(
        df.filter(B.is_valid_score(F.col(score))), B.floor_2(F.col(score)), B.CUSTOM_EDGES
    )


def select_per_bin(
    df: DataFrame,
    n: int = B.PER_BIN,
    score: str = "score_norm",
    within: Sequence[str] = (),
    row_key: Sequence[str] = ("dataname", "id"),
    order_by: Sequence[Column | str] = ("id",),
    seed: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """First ``n`` rows of each bin (and group), or ``n`` hashed ones with a seed.

    Ties in ``order_by`` go by ``row_key``; nulls in a group or key are values.

    Only keys are ranked.  Every task keeps the least ``n`` of each bin before anything is
    shuffled, so a bin holding most rows sends ``n`` rows a task.  Spark does so up to
    the ``n`` of its group limit; beyond that, or when ``salts`` is given, ranking runs first
    inside hashed salts.  The whole records are fetched by key at the end.
    """
    if seed is not None:
        order_by = (hash60(seed, *[F.col(c) for c in row_key]), *row_key)
    order = [c if isinstance(c, Column) else F.col(c) for c in (*order_by, *row_key)]
    names = list(dict.fromkeys([*within, *row_key]))
    slim = df.filter(B.is_valid_score(F.col(score))).select(
        *names,
        custom_bin(score).alias("bin"),
        *[c.alias(f"_o{i}") for i, c in enumerate(order)],
    )
    scopes = [[*within, "bin"]]
    limited = int(df.sparkSession.conf.get(GROUP_LIMIT, "1000"))
    if salts or n > limited:
        slim = slim.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(salts or SELECT_SALTS)))
        scopes.insert(0, [*within, "bin", "_salt"])
    ranks = [f"_o{i}" for i in range(len(order))]
    for scope in scopes:
        rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*ranks))
        slim = slim.withColumn("rank", rank).filter(F.col("rank") <= n)
    chosen = slim.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "bin", "rank")
    # at most n rows per bin and group; written so that the join knows its size
    chosen = materialise(chosen, "selection")
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}"))
    return df.join(chosen, same).select(*[F.col(f"`{c}`") for c in df.columns], "bin", "rank")


def selection_report(
    df: DataFrame, n: int = B.PER_BIN, score: str = "score_norm", within: Sequence[str] = ()
) -> DataFrame:
    """Per bin: rows, requested, selected; with the totals of the whole selection."""
    if within:
        valid = df.filter(B.is_valid_score(F.col(score)))
        counts = histogram_by(valid, within, B.floor_2(F.col(score)), B.CUSTOM_EDGES)
    else:
        counts = bin_counts(df, score)
    per_bin = counts.select(
        *within,
        "bin",
        "lower",
        "upper",
        F.col("count").alias("raw"),
        F.lit(n).cast("bigint").alias("requested"),
        F.least(F.col("count"), F.lit(n)).alias("selected"),
    )
    # one row per bin of a group: the window is over 16 rows
    whole = Window.partitionBy(*(within or [F.lit(0)]))
    return per_bin.withColumn("expected_total", F.sum("requested").over(whole)).withColumn(
        "actual_total", F.sum("selected").over(whole)
    )


def error_rate(
    df: DataFrame,
    score: str = "score_norm",
    edges: Sequence[float] = B.UNIFORM_EDGES,
    decimals: int = 2,
) -> DataFrame:
    """Total, errors, correct and error rate per right-closed score bin."""
    n = len(edges) - 1
    labels = F.array(
        *[F.lit(B.range_label(edges[i], edges[i + 1], decimals)) for i in range(n)]
    )
    wrong = error_flag(F.col("label"), F.col("predict")).cast("bigint")
    measures = {"total": F.lit(1).cast("bigint"), "errors": wrong}
    return _per_bin(df, F.col(score), edges, measures, closed="right").select(
        F.col("bin").alias("bin_index"),
        F.element_at(labels, F.col("bin") + 1).alias("bin"),
        "total",
        "errors",
        (F.col("total") - F.col("errors")).alias("correct"),
        (F.col("errors") / F.greatest("total", F.lit(1))).alias("error_rate"),
    )


def error_rate_log(df: DataFrame, score: str = "score_log") -> DataFrame:
    """Error rate over the integer bins 0..10 of the log score."""
    return error_rate(df, score, B.LOG_EDGES, decimals=0)


def band_distribution(df: DataFrame, score: str = "score_norm") -> DataFrame:
    """Count and percent in the half-open bands; the upper end 1.0 is in none."""
    edges = B.BAND_EDGES
    n = len(edges) - 1
    index = B.bin_index(F.col(score), edges, last_closed=False)
    totals = df.select(index.alias("b")).agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.count(F.when(F.col("b") == i, 1)) for i in range(n)]).alias("counts"),
    )
    return totals.select("total", F.posexplode("counts").alias("bin", "count")).select(
        B.edge_at(F.col("bin"), edges).alias("lower"),
        B.edge_at(F.col("bin") + 1, edges).alias("upper"),
        "count",
        (F.col("count") / F.greatest("total", F.lit(1)) * 100).alias("percent"),
    )


def bucket(score: Column) -> Column:
    """Difficulty bucket 0..3, null outside [0, 1)."""
    return B.bin_index(score, B.BUCKET_EDGES, last_closed=False)


def bucket_members(df: DataFrame, stage: int, score: str = "score_norm") -> DataFrame:
    """Rows of all buckets up to ``stage``."""
    edges = B.BUCKET_EDGES[: stage + 2]
    kept = df.filter(B.in_range(F.col(score), edges, last_closed=False))
    return kept.withColumn("bucket", bucket(F.col(score)))


def difficulty_masks(df: DataFrame, score: str = "score_norm") -> DataFrame:
    """Cumulative easy / medium / hard flags."""
    return df.select(
        "*", *[(F.col(score) <= limit).alias(name) for name, limit in B.DIFFICULTY_LIMITS.items()]
    )
