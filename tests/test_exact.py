"""Exact moments: the same bits on any partitioning, and the nearest doubles."""

import math
from fractions import Fraction

import numpy as np
import pytest

from gradus.operators.exact import exact_moments
from gradus.operators.scoring import normalise, score_stats


def by_fractions(values):
    exact = [Fraction(v) for v in values]
    mean = sum(exact) / len(exact)
    return float(mean), float(sum(x * x for x in exact) / len(exact) - mean * mean)


RNG = np.random.default_rng(8)
SAMPLES = {
    "scores": RNG.gamma(2.0, 1.7, 3000).tolist(),
    "wide": (RNG.standard_normal(500) * 10.0 ** RNG.integers(-150, 150, 500)).tolist(),
    "tiny": [5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 0.0, -0.0],
    "large": [1.7976931348623157e308 / 2**600, 2.0**400, -(2.0**400), 3.0],
    "powers": [2.0**k * s for k in range(-60, 61) for s in (1, -1, 1.5)] + [np.nextafter(2.0**k, 0) for k in range(-60, 61)],
    "equal": [0.1] * 77,
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_nearest_doubles_on_any_partitioning(spark, name):
    values = [float(v) for v in SAMPLES[name]]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    found = {tuple(exact_moments(frame.repartition(n), "x").first()) for n in (1, 3, 7, 13)}
    assert found == {by_fractions(values)}


def test_what_is_not_finite_and_what_is_not_there(spark):
    rows = [("a", 1.0), ("a", math.inf), ("b", math.nan), ("b", 1.0), ("c", math.inf), ("c", -math.inf), ("d", None), (None, 2.0), ("e", -math.inf)]
    found = {r.g: (r.mean, r.variance) for r in exact_moments(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    assert found["a"][0] == math.inf and found["e"][0] == -math.inf and math.isnan(found["a"][1])
    assert math.isnan(found["b"][0]) and math.isnan(found["c"][0])
    assert found["d"] == (None, None) and found[None] == (2.0, 0.0)
    none = spark.createDataFrame([], "g string, x double")
    assert tuple(exact_moments(none, "x").first()) == (None, None)
    assert exact_moments(none, "x", ["g"]).count() == 0


def test_normalised_scores_do_not_depend_on_partitions(spark):
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(SAMPLES["scores"])]
    frame = spark.createDataFrame(rows, "id long, dataname string, score_log double")
    for by in ([], ["dataname"]):
        found = [{(r.id, r.score_norm) for r in normalise(frame.repartition(n), group_cols=by).collect()} for n in (1, 7, 13)]
        assert found[0] == found[1] == found[2]
    assert score_stats(frame).columns == ["mean", "variance"]
