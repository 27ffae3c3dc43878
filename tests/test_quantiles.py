"""Quantiles by sketch and refinement, and batches of prompts of like lengths."""

import math

import numpy as np
import pytest

from gradus.operators.binning import select_per_bin
from gradus.operators.generate import generate_batch, length_batches, padding_share
from gradus.operators.quantiles import quantile

RNG = np.random.default_rng(6)
SAMPLES = {
    "spread": RNG.standard_normal(4000).tolist(),
    "ties": RNG.integers(0, 4, 4000).astype(float).tolist(),
    "skew": [0.5] * 3900 + RNG.standard_normal(100).tolist(),
    "few": [3.0, 1.0, 2.0],
    "one": [7.0],
    "infinite": [math.inf] * 5 + [-math.inf] * 3 + [0.0] * 2000,
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_equal_to_a_whole_sort(spark, name):
    values = SAMPLES[name]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(5)
    ordered = sorted(values)
    for fraction in (0.0, 0.3, 0.5, 0.999, 1.0):
        at = fraction * (len(values) - 1)
        low = math.floor(at)
        expected = ordered[low]
        if at > low:
            expected += (ordered[low + 1] - ordered[low]) * (at - low)
        for accuracy, fetched in ((10_000, 5_000), (50, 10)):
            found = quantile(frame, "x", fraction, accuracy=accuracy, fetched=fetched)
            assert found == expected or (math.isnan(found) and math.isnan(expected))


def test_nulls_and_nan(spark):
    frame = spark.createDataFrame([(1.0,), (math.nan,), (None,), (2.0,)], "x double")
    assert quantile(frame, "x", 0.0) == 1.0 and quantile(frame, "x", 0.5) == 2.0
    assert math.isnan(quantile(frame, "x", 0.75)) and math.isnan(quantile(frame, "x", 1.0))
    assert quantile(frame.where("x IS NULL"), "x", 0.5) is None
    assert quantile(frame.where("x < 3"), "x", 0.5, approximate=True) in (1.0, 2.0)
    with pytest.raises(ValueError):
        quantile(frame, "x", 1.5)


def test_a_task_sends_few_rows_of_a_bin(spark):
    frame = spark.range(5000).selectExpr("concat('d', id % 2) AS dataname", "id", "0.5D AS score_norm")
    plan = select_per_bin(frame, n=4)
    assert plan.count() == 4
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranked = frame.withColumn("r", F.row_number().over(Window.partitionBy("dataname").orderBy("id"))).where("r <= 4")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    try:
        assert {r.id for r in select_per_bin(frame, n=4).collect()} == {0, 1, 2, 3}
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_batches_of_like_lengths(spark):
    lengths = RNG.integers(1, 2000, 3000).tolist() + [500_000]
    mixed = [list(range(a, min(a + 128, 3001))) for a in range(0, 3001, 128)]
    batches = length_batches(lengths, 128, 100_000)
    assert sorted(i for b in batches for i in b) == list(range(3001))
    for b in batches:
        assert len(b) <= 128 and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 100_000)
    assert padding_share(lengths, batches) < 0.03 < 0.4 < padding_share(lengths, mixed)
    assert padding_share([], []) == 0

    def make():
        def generate(prompts):
            longest = max(map(len, prompts))
            if len(prompts) * longest > 5000 and len(prompts) > 1:
                raise MemoryError("too much at once")
            return [p[::-1] for p in prompts]

        return generate

    rows = [(i, None if i % 50 == 7 else "x" * (9000 if i == 3 else i % 60) + str(i)) for i in range(700)]
    frame = spark.createDataFrame(rows, "id long, prompt string").selectExpr("*", "'old' AS error").coalesce(1)
    found = generate_batch(frame, make, batch_chars=5000, window_chars=3000).collect()
    assert [(r.id, r.generated_text, r.error) for r in found] == [(i, p and p[::-1], None) for i, p in rows]
