"""Joins of the pipeline: repair upsert, resume anti join, positional zip."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.hashing import hash60, uniform
from gradus.operators.ordering import with_position
from gradus.storage import materialise

# Fixed value: suffix of a repair file.
REPAIR_SUFFIX = r"(?i)_error\.json$"


def first_targets(
    target: DataFrame, repaired: DataFrame, keys: Sequence[str], order: str, more: Sequence[str] = ()
) -> DataFrame:
    """(keys, order, more) of the first target record of each repaired key."""
    return (
        target.select(*keys, order, *more)
        .join(repaired.select(*keys), list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.min(F.struct(order, *more)).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (order, *more)])
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str] = ("dataname", "id"),
    order: str = "ordinal",
) -> DataFrame:
    """Replace whole target records by the repaired record of the same key.

    The last source record of a key wins and replaces the first target record of
    that key; null keys match nothing and unmatched source records are ignored.
    ``order`` is a unique row number in both inputs.  A table that is kept is repaired
    file by file with :func:`gradus.sources.versions.merge_table`.
    """
    keys = list(keys)
    fields = [c for c in target.columns if c not in (order, *keys)]
    repaired = (
        source.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*fields), order).alias("_new"))
    )
    # The record to replace is found on keys alone, then joined on (key, order):
    # a key repeated in many target rows does not gather in one task.
    first = first_targets(target, repaired, keys, order)
    # Written first, so that its size is known: a small table is broadcast and the
    # target is not shuffled, a large one is sort-merge joined.
    patches = materialise(first.join(repaired, keys), "patches")
    joined = target.join(patches, [*keys, order], "left")
    return joined.select(
        *keys,
        order,
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            for c in fields
        ],
    )


def repair_target(file_name: Column) -> Column:
    """Name of the file a repair file belongs to."""
    return F.regexp_replace(file_name, REPAIR_SUFFIX, ".json")


def pair_files(repairs: DataFrame, targets: DataFrame, name: str = "file_name") -> DataFrame:
    """Repair files with the target file of the matching name; others are skipped."""
    repair = (
        repairs.filter(F.col(name).rlike(REPAIR_SUFFIX))
        .select(F.col(name).alias("repair_file"))
        .distinct()
        .withColumn("target_file", repair_target(F.col("repair_file")))
    )
    return repair.join(
        targets.select(F.col(name).alias("target_file")).distinct(), "target_file", "left_semi"
    )


def upsert_files(
    targets: DataFrame, repairs: DataFrame, keys: Sequence[str] = ("id",), order: str = "ordinal"
) -> DataFrame:
    """Upsert many files at once: the file name is part of the key."""
    matched = repairs.filter(F.col("file_name").rlike(REPAIR_SUFFIX)).withColumn(
        "file_name", repair_target(F.col("file_name"))
    )
    return upsert(targets, matched, ("file_name", *keys), order)


def anti_join_done(
    df: DataFrame, done: DataFrame, keys: Sequence[str] = ("dataname", "id")
) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def attach_scores(
    predictions: DataFrame,
    scores: DataFrame,
    prediction_order: Sequence[Column | str],
    score_order: Sequence[Column | str],
    score_columns: Sequence[str] = ("score_log", "score_norm"),
) -> DataFrame:
    """Give the i-th prediction the scores of the i-th scored item."""
    left = with_position(predictions, prediction_order)
    right = with_position(scores, score_order).select("position", *score_columns)
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"{n_left} predictions but {n_right} scored items")
    return left.join(right, "position")


def union_datasets(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenate data sets; fields missing on one side become null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def split_train_eval(
    df: DataFrame,
    mode: int = 1,
    eval_df: DataFrame | None = None,
    fraction: float = 0.1,
    seed: int = 0,
    row_key: Sequence[str] = ("dataname", "id"),
    exact: bool = False,
) -> DataFrame:
    """Add ``role`` train / eval.

    Mode 0: all train.  Mode 1: hold out ``fraction`` by a hash of the key, or
    exactly ``ceil(fraction * n)`` rows with ``exact``.  Mode 2: ``eval_df`` is
    the evaluation set.
    """
    train = F.lit("train")
    if mode == 0:
        return df.withColumn("role", train)
    if mode == 2:
        if eval_df is None:
            raise ValueError("mode 2 needs eval_df")
        return df.withColumn("role", train).unionByName(
            eval_df.withColumn("role", F.lit("eval")), allowMissingColumns=True
        )
    keys = [F.col(k) for k in row_key]
    if not exact:
        held = uniform(seed, *keys) < fraction
        return df.withColumn("role", F.when(held, "eval").otherwise(train))
    slim = with_position(
        df.select(*row_key).withColumn("_h", hash60(seed, *keys)), ["_h", *row_key]
    )
    n_eval = math.ceil(slim.count() * fraction)
    held = slim.filter(F.col("position") < n_eval).select(*row_key, F.lit("eval").alias("_role"))
    return (
        df.join(materialise(held, "held-out"), list(row_key), "left")
        .withColumn("role", F.coalesce("_role", train))
        .drop("_role")
    )
