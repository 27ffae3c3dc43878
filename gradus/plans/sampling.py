"""Sampling plans: which item at which position of which epoch.

A plan is a table ``(epoch, position, <item key>)``.  Draws come from a hash of
(seed, epoch, position), so a plan can be rebuilt exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.hashing import hash60, hash120
from gradus.operators.quantiles import quantile
from gradus.operators.ordering import order_by_score, sorted_ranges, with_position
from gradus.plans.schedule import (
    EPOCHS,
    STAGE_EPOCHS,
    STAGE_WEIGHTS,
    Curriculum,
    stage_of_epoch,
    staged_weight,
)

# Fixed value: weights are compared as whole numbers of this fraction.
WEIGHT_SCALE = 1_000_000
SCORE_OFFSET = 1e-6

KEY = ("dataname", "id")


def integer_weight(weight: Column, scale: int = WEIGHT_SCALE) -> Column:
    """Weight as a whole number, so that prefix sums do not depend on their order."""
    return F.round(weight * scale).cast("bigint")


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, exact beyond the precision of a double."""
    return F.call_function("div", a, b)


def _each_epoch(first: int, last: int) -> Column:
    return F.explode(F.sequence(F.lit(first), F.lit(last))).alias("epoch")


def plan_sequential(
    items: DataFrame, epochs: int = EPOCHS, key: Sequence[str] = KEY, first_epoch: int = 0
) -> DataFrame:
    """Natural (key) order in every epoch."""
    numbered = with_position(items.select(*key), list(key))
    return numbered.select(_each_epoch(first_epoch, epochs - 1), "position", *key)


def plan_sorted(
    items: DataFrame,
    epochs: int = EPOCHS,
    key: Sequence[str] = KEY,
    score: str = "score_norm",
    descending: bool = False,
) -> DataFrame:
    """Score order in every epoch, ties in key order."""
    slim = items.select(*key, score, F.struct(*key).alias("_tie"))
    ordered = order_by_score(slim, score, "_tie", descending)
    return ordered.select(_each_epoch(0, epochs - 1), "position", *key)


def plan_shuffle(
    items: DataFrame, epochs: int = EPOCHS, key: Sequence[str] = KEY, seed: int = 0
) -> DataFrame:
    """A fresh hashed order in every epoch."""
    rows = items.select(_each_epoch(0, epochs - 1), *key)
    rows = rows.withColumn("_h", hash60(seed, F.col("epoch"), *[F.col(k) for k in key]))
    return with_position(rows, ["_h", *key], within=["epoch"]).select("epoch", "position", *key)


WHOLE = "decimal(38,0)"
#: Draws that share a copy of the items of their bucket, as a multiple of these items.
DRAWS_PER_COPY = 4
DRAWS_PER_NUMBER = 4096


class _Line:
    """Items in key order, as ranges, with the size and weight of each range.

    The order is made once and serves every stage: the weights are an array.
    """

    def __init__(self, items: DataFrame, key: Sequence[str], weights: Sequence[Column]) -> None:
        self.key, self.stages = list(key), range(len(weights))
        slim = items.select(*key, F.array(*weights).alias("_w"))
        self.ranged = sorted_ranges(slim, list(key), "weights")
        # One row per range partition.
        self.sizes = (
            self.ranged.groupBy("_part")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.array(*[F.sum(F.col("_w")[i].cast(WHOLE)) for i in self.stages]).alias("w"),
            )
            .orderBy("_part")
            .collect()
        )
        self.n_items = sum(r.n for r in self.sizes)

    def positions(self, epochs: Sequence[int]) -> DataFrame:
        """The key order itself, in the given epochs."""
        offsets, at = [], 0
        for r in self.sizes:
            offsets.append((r["_part"], at))
            at += r.n
        table = self.ranged.sparkSession.createDataFrame(offsets, "_part bigint, _off bigint")
        return self.ranged.join(F.broadcast(table), "_part").select(
            F.explode(F.array(*[F.lit(int(e)) for e in epochs])).alias("epoch"),
            (F.col("_off") + F.col("_seq")).alias("position"),
            *self.key,
        )

    def draws(self, epochs: Sequence[int], stage: Column, seed: int) -> DataFrame:
        """As many draws per epoch as there are items, by the weights of its stage."""
        spark = self.ranged.sparkSession
        total = {s: sum(int(r.w[s] or 0) for r in self.sizes) for s in self.stages}
        if not self.n_items or not all(total.values()):
            raise ValueError("there must be items, and each stage needs a positive total weight")
        if max(total.values()) >= 10**37:
            raise ValueError("total weight beyond 37 digits")
        # The line is cut into equal cells; each cell lists the buckets it touches.
        # A bucket's draws of all epochs are shared among copies of its items, so
        # that none has many more draws than items: some epochs' worth of copies at
        # most, however the weights lie.
        cells = max(1, len(self.sizes))
        width = {s: -(-total[s] // cells) for s in self.stages}
        ends, salts, start = [], [], dict.fromkeys(self.stages, 0)
        for r in self.sizes:
            for s in self.stages:
                lo, hi = start[s], start[s] + int(r.w[s] or 0)
                start[s] = hi
                if hi > lo:
                    share = (hi - lo) * self.n_items * len(epochs)
                    copies = max(1, -(-share // (total[s] * r.n * DRAWS_PER_COPY)))
                    salts.append((s, r["_part"], copies))
                    for cell in range(lo // width[s], (hi - 1) // width[s] + 1):
                        ends.append((s, Decimal(cell), r["_part"], Decimal(lo), Decimal(hi), copies))
        buckets = spark.createDataFrame(
            ends,
            f"_stage int, _cell {WHOLE}, _bucket bigint, _lo {WHOLE}, _hi {WHOLE}, _copies int",
        )
        copies = spark.createDataFrame(salts, "stage int, _part bigint, _copies int")

        def per_stage(values: dict[int, int]) -> Column:
            chain = F.lit(None).cast(WHOLE)
            for s in self.stages:
                chain = F.when(F.col("stage") == s, F.lit(Decimal(values[s])).cast(WHOLE)).otherwise(chain)
            return chain

        epoch_array = F.array(*[F.lit(int(e)) for e in epochs])
        n = self.n_items
        drawn = (
            spark.range(n * len(epochs))
            .select(
                F.element_at(epoch_array, (_div(F.col("id"), F.lit(n)) + 1).cast("int")).alias("epoch"),
                (F.col("id") % n).alias("position"),
            )
            .withColumn("stage", stage.cast("int"))
            .withColumn("u", (hash120(seed, F.col("epoch"), F.col("position")) % per_stage(total)).cast(WHOLE))
            .withColumn("_c", F.floor(_div(F.col("u"), per_stage(width))).cast(WHOLE))
        )
        # at most two rows per range partition and stage
        placed = drawn.join(
            F.broadcast(buckets),
            (F.col("stage") == F.col("_stage"))
            & (F.col("_c") == F.col("_cell"))
            & (F.col("u") >= F.col("_lo"))
            & (F.col("u") < F.col("_hi")),
        ).select(
            "stage",
            F.col("_bucket").alias("_part"),
            F.pmod(F.xxhash64("epoch", "position"), F.col("_copies")).cast("int").alias("_salt"),
            (F.col("u") - F.col("_lo")).cast(WHOLE).alias("place"),
            "epoch",
            "position",
        )
        in_bucket = Window.partitionBy("_part").orderBy("_seq")
        ends_of_items = [F.sum(F.col("_w")[s].cast(WHOLE)).over(in_bucket) for s in self.stages]
        starts = self.ranged.withColumn("_ends", F.array(*ends_of_items)).select(
            "_part",
            *self.key,
            F.posexplode(F.arrays_zip("_w", "_ends")).alias("stage", "_s"),
        ).select(
            "_part",
            *self.key,
            "stage",
            F.col("_s._w").alias("weight"),
            (F.col("_s._ends") - F.col("_s._w")).cast(WHOLE).alias("place"),
        )
        merged = (
            starts.filter(F.col("weight") > 0)
            .join(F.broadcast(copies), ["stage", "_part"])
            .select(
                "stage",
                "_part",
                F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_salt"),
                "place",
                F.struct(*self.key).alias("item"),
            )
            .unionByName(placed, allowMissingColumns=True)
        )
        last_start = Window.partitionBy("stage", "_part", "_salt").orderBy(
            "place", F.col("epoch").asc_nulls_first()
        ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            merged.withColumn("item", F.last("item", ignorenulls=True).over(last_start))
            .filter(F.col("position").isNotNull())
            .select("epoch", "position", "item.*")
        )


def weighted_draws(
    items: DataFrame,
    stage_weights: Sequence[Column],
    epochs: Sequence[int],
    stage: Column,
    key: Sequence[str] = KEY,
    seed: int = 0,
) -> DataFrame:
    """As many draws with replacement per epoch as there are items.

    ``stage_weights`` gives the whole-number weight of each stage, ``stage`` the
    stage of the ``epoch`` column.  Items lie one after the other on a line, each
    as long as its weight; a draw is a point of that line.  Range partitions of
    the items are the buckets, so no bucket has more than its share of items
    however small their weights.  A draw finds its bucket through a table of
    bucket ends (as many rows as buckets) and its item by one sort per bucket:
    items and draws are merged on their place and the last item start before a
    draw is the item drawn.  Nothing is compared pairwise.  Places are whole numbers
    of up to 37 digits, drawn from 120 bits, so no table is too large for them.
    """
    return _Line(items, key, stage_weights).draws(epochs, stage, seed)


def plan_weighted(
    items: DataFrame,
    epochs: int = EPOCHS,
    key: Sequence[str] = KEY,
    score: str = "score_norm",
    seed: int = 0,
    scale: int = WEIGHT_SCALE,
) -> DataFrame:
    """Epoch 0 in order; later epochs draw with weight ``score + 1e-6``."""
    weight = integer_weight(F.coalesce(score, F.lit(0.0)) + SCORE_OFFSET, scale)
    if epochs <= 1:
        return plan_sequential(items, epochs, key)
    line = _Line(items, key, [weight])
    return line.positions([0]).unionByName(line.draws(range(1, epochs), F.lit(0), seed))


def plan_staged(
    items: DataFrame,
    epochs: int = EPOCHS,
    key: Sequence[str] = KEY,
    score: str = "score_norm",
    seed: int = 0,
    scale: int = WEIGHT_SCALE,
    stage_epochs: Sequence[int] = STAGE_EPOCHS,
    stage_weights: Sequence[float] = STAGE_WEIGHTS,
) -> DataFrame:
    """Every epoch draws with the weights of its stage."""
    weights = [
        integer_weight(staged_weight(F.col(score), s, stage_weights), scale)
        for s in range(len(stage_weights))
    ]
    return weighted_draws(
        items, weights, range(epochs), stage_of_epoch(F.col("epoch"), stage_epochs), key, seed
    )


@dataclass(frozen=True)
class _Admitted:
    """What a curriculum needs to know of its items."""

    limits: list[float]
    sizes: list[int]
    n_hard: int


def score_quantile(
    items: DataFrame, fraction: float, score: str = "score_norm", approximate: bool = False
) -> float | None:
    """Quantile with linear interpolation: exact, from a sketch and filtered passes, or the sketch's own."""
    return quantile(items, score, fraction, approximate)


def _within(items: DataFrame, limits: Sequence[float], score: str, hard: float) -> tuple[int, int, list[int]]:
    """Rows, hard rows, and rows within each limit; one pass."""
    row = items.agg(
        F.count(F.lit(1)),
        F.count(F.when(F.col(score) > hard, 1)),
        *[F.count(F.when(F.col(score) <= x, 1)) for x in limits],
    ).first()
    return row[0], row[1], list(row[2:])


def _admit(items: DataFrame, settings: Curriculum, score: str, approximate: bool = False) -> _Admitted:
    limits = settings.limits()
    n, n_hard, sizes = _within(items, limits, score, settings.hard_score)
    short = [i for i, size in enumerate(sizes) if size < settings.min_coverage * n]
    least = quantile(items, score, settings.min_coverage, approximate) if short else None
    if least is not None:
        size = items.filter(F.col(score) <= least).count()
        for i in short:
            limits[i], sizes[i] = least, size
    return _Admitted(limits, sizes, n_hard)


def curriculum_limits(
    items: DataFrame,
    settings: Curriculum = Curriculum(),
    score: str = "score_norm",
    approximate: bool = False,
) -> list[float]:
    """Score limit per epoch; epochs that would admit too few items use the quantile."""
    return _admit(items, settings, score, approximate).limits


def _eligible(items: DataFrame, limits: Sequence[float], score: str, columns: Sequence[str]) -> DataFrame:
    admitted = F.array(*[F.when(F.col(score) <= x, F.lit(i)) for i, x in enumerate(limits)])
    epochs = F.filter(admitted, lambda e: e.isNotNull())
    return items.select(F.explode(epochs).alias("epoch"), *columns)


def curriculum_eligible(
    items: DataFrame,
    settings: Curriculum = Curriculum(),
    score: str = "score_norm",
    key: Sequence[str] = KEY,
    approximate: bool = False,
) -> DataFrame:
    """(epoch, key, score) of every item admitted in an epoch; ``approximate`` takes the sketch's quantile."""
    limits = curriculum_limits(items, settings, score, approximate)
    return _eligible(items, limits, score, [*key, score])


def curriculum_oversample(
    items: DataFrame,
    settings: Curriculum = Curriculum(),
    score: str = "score_norm",
    key: Sequence[str] = KEY,
    seed: int = 0,
    with_score: bool = False,
) -> DataFrame:
    """Extra draws of hard items for the early epochs, at the end of each epoch.

    The hard items are numbered in score order, so a draw is an equi-join on the
    number.
    """
    kept = [*key, score] if with_score else list(key)
    return _oversample(items, _admit(items, settings, score), settings, score, key, kept, seed)


def _oversample(
    items: DataFrame, admitted: _Admitted, settings: Curriculum, score: str, key: Sequence[str],
    kept: Sequence[str], seed: int,
) -> DataFrame:
    early = [e for e, x in enumerate(settings.limits()) if x < settings.oversample_below]
    extra = [(e, size, int(size * settings.oversample_share)) for e, size in enumerate(admitted.sizes) if e in early]
    # Only the hard items are sorted.
    numbered = items.select(score, *key).filter(F.col(score) > settings.hard_score)
    hard = with_position(numbered, [score, *key], name="_number").select("_number", *kept)
    spark = hard.sparkSession
    draws = None
    for epoch, size, n in extra if admitted.n_hard else []:
        part = spark.range(n).select(
            F.lit(epoch).alias("epoch"),
            (F.col("id") + size).alias("position"),
            F.pmod(hash60(seed, "hard", epoch, F.col("id")), F.lit(admitted.n_hard)).alias("_number"),
        )
        draws = part if draws is None else draws.unionByName(part)
    if draws is None:
        return hard.filter(F.lit(False)).select(
            F.lit(0).alias("epoch"), F.lit(0).cast("bigint").alias("position"), *kept
        )
    # Few hard items share many draws: a number is cut over copies of its item, so
    # that no copy has more than some thousand draws.
    copies = max(1, sum(n for _, _, n in extra) // (admitted.n_hard * DRAWS_PER_NUMBER))
    salted = hard.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = draws.withColumn("_salt", F.pmod(F.xxhash64("epoch", "position"), F.lit(copies)).cast("int"))
    return dealt.join(salted, ["_number", "_salt"]).select("epoch", "position", *kept)


def plan_curriculum(
    items: DataFrame,
    settings: Curriculum = Curriculum(),
    score: str = "score_norm",
    key: Sequence[str] = KEY,
    seed: int = 0,
    with_score: bool = False,
) -> DataFrame:
    """Shuffled eligible items per epoch, then the extra hard draws.

    ``with_score`` keeps the score, so that statistics of the plan need no join.
    Building the frame counts the items and sorts the hard ones.
    """
    kept = [*key, score] if with_score else list(key)
    admitted = _admit(items, settings, score)
    shuffled = with_position(
        _eligible(items, admitted.limits, score, [*key, score]).select(
            "epoch", *kept, hash60(seed, F.col("epoch"), *[F.col(k) for k in key]).alias("_h")
        ),
        ["_h", *key],
        within=["epoch"],
    ).select("epoch", "position", *kept)
    return shuffled.unionByName(_oversample(items, admitted, settings, score, key, kept, seed))


METHODS = ("sequential", "sorted", "shuffle", "weighted", "staged", "curriculum")


def sampling_plan(items: DataFrame, method: str, epochs: int = EPOCHS, seed: int = 0, **options) -> DataFrame:
    """Plan by method name; see :data:`METHODS`."""
    if method == "sequential":
        return plan_sequential(items, epochs, **options)
    if method == "sorted":
        return plan_sorted(items, epochs, **options)
    if method == "shuffle":
        return plan_shuffle(items, epochs, seed=seed, **options)
    if method == "weighted":
        return plan_weighted(items, epochs, seed=seed, **options)
    if method == "staged":
        return plan_staged(items, epochs, seed=seed, **options)
    if method == "curriculum":
        return plan_curriculum(items, Curriculum(epochs=epochs), seed=seed, **options)
    raise ValueError(f"method must be one of {METHODS}")
