"""Statistics of a sampling plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions.bins import HARD_SCORE

KEY = ("dataname", "id")


def scored_plan(plan: DataFrame, items: DataFrame, score: str = "score_norm", key: Sequence[str] = KEY) -> DataFrame:
    """Plan rows with the score of their item."""
    return plan.join(items.select(*key, score), list(key))


def plan_monitor(plan: DataFrame, n_items: int, score: str = "score_norm") -> DataFrame:
    """Per epoch: mean score, hard rows, their percent, and rows per item."""
    hard = F.count(F.when(F.col(score) > HARD_SCORE, 1))
    n = F.count(F.lit(1))
    return plan.groupBy("epoch").agg(
        F.avg(score).alias("mean_score"),
        hard.alias("n_hard"),
        (hard / n * 100).alias("hard_percent"),
        n.alias("n_rows"),
        (n / F.lit(max(n_items, 1)) * 100).alias("coverage_percent"),
    )


def batch_difficulty(plan: DataFrame, batch_size: int = 16, score: str = "score_norm") -> DataFrame:
    """Mean and largest score of each batch of the sampled order."""
    return plan.groupBy("epoch", F.floor(F.col("position") / batch_size).alias("batch")).agg(
        F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.count(F.lit(1)).alias("n_rows")
    )
