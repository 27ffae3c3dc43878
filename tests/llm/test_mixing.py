import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradus.functions.hashing import hash60
from gradus.llm.mixing import mix_sources, poisson_steps
from tests.llm.helpers import docs


def inverse(u, mean):
    p = c = math.exp(-mean)
    k = 0
    while u >= c and k < 400:
        k += 1
        p *= mean / k
        c += p
    return k


def test_draws_are_the_inverse_of_the_distribution(spark):
    frame = docs(spark, ["t"] * 400, "a").union(docs(spark, ["t"] * 100, "b"))
    mixed = mix_sources(frame, {"a": 1, "b": 3}, target_rows=1000, seed=5).collect()
    rate = {"a": 250 / 400, "b": 750 / 100}
    uniforms = frame.select(
        "doc_id", "source", (F.shiftright(hash60(5, "poisson", F.col("doc_id"), F.lit(1)), 7) / 2.0**53).alias("u")
    ).collect()
    expected = Counter({(r.doc_id, r.source): inverse(r.u, rate[r.source]) for r in uniforms})
    assert Counter((r.doc_id, r.source) for r in mixed) == +expected
    for key, n in (+expected).items():
        assert sorted(r["copy"] for r in mixed if (r.doc_id, r.source) == key) == list(range(1, n + 1))


def test_shares_and_large_means(spark):
    frame = docs(spark, ["t"] * 3000, "hot").union(docs(spark, ["t"] * 30, "rare"))
    mixed = mix_sources(frame, {"hot": 1, "rare": 1, "absent": 5}, target_rows=6000)
    # 30 rows repeated 100 times each: the mean is drawn in parts.
    n = dict(mixed.groupBy("source").count().collect())
    assert abs(n["hot"] - 3000) < 250 and abs(n["rare"] - 3000) < 250
    assert mixed.count() == mix_sources(frame, {"hot": 1, "rare": 1}, target_rows=6000).count()
    keys = [r.shuffle_key for r in mixed.collect()]
    assert len(set(keys)) > 0.98 * len(keys)


def test_steps_end_below_the_largest(spark):
    steps = spark.range(1).select(poisson_steps(F.lit(32.0)).alias("s")).first().s
    assert steps == sorted(steps) and len(set(steps)) == len(steps) and steps[-1] < 1.0000001


def test_odd_tables(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    frame = docs(spark, [None, "", "x"]).withColumn("source", F.lit(None).cast("string"))
    clash = frame.selectExpr("*", "9 AS copy", "8 AS shuffle_key", "7 AS rate", "6 AS rows")
    mixed = mix_sources(clash, {None: 1.0}, target_rows=30)
    assert mixed.columns == [*frame.columns, "rate", "rows", "copy", "shuffle_key"]
    assert mixed.count() > 0 and mixed.where("rate <> 7 OR rows <> 6").count() == 0
    twice = mix_sources(frame.unionByName(frame), power=1.0, target_rows=60)
    assert all(n % 2 == 0 for n in Counter(r.doc_id for r in twice.collect()).values())
    nulls = frame.withColumn("doc_id", F.lit(None).cast("long"))
    assert mix_sources(nulls, target_rows=30).count() % 3 == 0
    assert mix_sources(frame, {"other": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mix_sources(frame, {"a": -1.0})
