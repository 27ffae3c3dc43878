"""Epoch schedules: a handful of numbers per training run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values
EPOCHS = 16
STAGE_EPOCHS = (3, 4, 4, 5)
STAGE_WEIGHTS = (1.0, 0.8, 0.6, 0.4)
# (lowest score, factor on the stage weight), hardest first; below them the weight is 1
SCORE_BOOSTS = ((0.7, 2.5), (0.5, 1.5))


@dataclass(frozen=True)
class Curriculum:
    """Settings of the growing difficulty limit.  The defaults are fixed values."""

    initial_max: float = 0.3
    epochs: int = EPOCHS
    warmup_epochs: int = 1
    min_coverage: float = 0.3
    turn: float = 0.7
    slow_rate: float = 0.15
    slow_decay: float = 0.5
    fast_rate: float = 0.3
    fast_growth: float = 2.0
    oversample_below: float = 0.8
    oversample_share: float = 0.1
    hard_score: float = 0.7

    def limits(self) -> list[float]:
        """Highest admitted score of each epoch."""
        limits, limit = [], self.initial_max
        for epoch in range(self.epochs):
            if epoch >= self.warmup_epochs:
                done = (epoch - self.warmup_epochs) / (self.epochs - self.warmup_epochs)
                slow = self.slow_rate * (1 - self.slow_decay * done)
                fast = self.fast_rate * (1 + self.fast_growth * (done - self.turn))
                step = slow if done <= self.turn else fast
                limit = min(1.0, limit + step * (1 - limit))
            limits.append(limit)
        return limits


def stage_of_epoch(epoch: Column, stage_epochs: Sequence[int] = STAGE_EPOCHS) -> Column:
    """Stage whose epoch span holds ``epoch``; epochs past the end stay in the last stage."""
    stage, end = F.lit(0), 0
    for length in stage_epochs[:-1]:
        end += length
        stage = stage + (epoch >= end).cast("int")
    return stage


def epoch_frame(spark: SparkSession, epochs: int = EPOCHS) -> DataFrame:
    return spark.range(0, epochs, 1, 1).select(F.col("id").cast("int").alias("epoch"))


def curriculum_frame(spark: SparkSession, settings: Curriculum = Curriculum()) -> DataFrame:
    """(epoch, max_score), one row per epoch."""
    limits = F.array(*[F.lit(x) for x in settings.limits()])
    return epoch_frame(spark, settings.epochs).select(
        "epoch", F.element_at(limits, F.col("epoch") + 1).alias("max_score")
    )


def staged_weight(score: Column, stage: int, stage_weights: Sequence[float] = STAGE_WEIGHTS) -> Column:
    """Draw weight of an item in a stage."""
    weight = F.lit(1.0)
    for lowest, factor in reversed(SCORE_BOOSTS):
        weight = F.when(score >= lowest, F.lit(stage_weights[stage] * factor)).otherwise(weight)
    return weight
