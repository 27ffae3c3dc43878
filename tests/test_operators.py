"""Operators on small fixtures, compared with brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import bins as B
from gradus.operators import binning as N
from gradus.operators import joins as J
from gradus.operators import metrics as M
from gradus.operators import ordering as O
from gradus.operators.filters import dedup_items
from gradus.operators.generate import generate_batch
from gradus.operators.scoring import normalise, score_items, score_stats
from gradus.plans import sampling as P
from gradus.plans.schedule import Curriculum, staged_weight, stage_of_epoch
from gradus.schema import EXTRACTED, file_schema, from_file_names, to_file_names, typed_cast


def scored(spark, n=500, seed=3, datasets=3):
    rng = random.Random(seed)
    rows = [
        ("hot" if rng.random() < 0.4 else f"d{i % datasets}", i, rng.random(), 5 * rng.random())
        for i in range(n)
    ]
    return rows, spark.createDataFrame(
        rows, "dataname string, id bigint, score_norm double, score_log double"
    )


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_do_not_depend_on_partitions(spark, partitions):
    rows, df = scored(spark)
    found = O.with_position(df.repartition(partitions), [F.col("score_norm").desc(), "id"]).collect()
    expected = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert [(r.dataname, r.id) for r in sorted(found, key=lambda r: r.position)] == [
        r[:2] for r in expected
    ]
    assert sorted(r.position for r in found) == list(range(len(rows)))


def test_positions_with_a_hot_value_and_null_group(spark):
    rows = [(None if i % 3 == 0 else "g", 1, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, same int, id bigint")
    found = O.with_position(df, ["same", "id"], within=["g"], start=5).collect()
    for group in (None, "g"):
        mine = sorted((r for r in found if r.g == group), key=lambda r: r.id)
        assert [r.position for r in mine] == list(range(5, 5 + len(mine)))


def test_positions_of_nothing(spark):
    _, df = scored(spark)
    assert O.with_position(df.filter("id < 0"), ["id"]).collect() == []


def test_normalise(spark):
    rows, df = scored(spark)
    x = np.array([r[3] for r in rows])
    z = (x - x.mean()) / math.sqrt(x.var() + 1e-5)
    expected = 1 / (1 + np.exp(-z))
    found = {r.id: r.score_norm for r in normalise(df.drop("score_norm")).collect()}
    assert np.allclose([found[r[1]] for r in rows], expected, atol=1e-12)
    assert all(0 < v < 1 for v in found.values())
    frozen = spark.createDataFrame([(1.0, 4.0)], "mean double, variance double")
    found = {r.id: r.score_norm for r in normalise(df.drop("score_norm"), frozen).collect()}
    assert np.allclose([found[r[1]] for r in rows], 1 / (1 + np.exp(-(x - 1) / math.sqrt(4 + 1e-5))))


def test_score_items_keeps_rows_and_columns(spark):
    ddl = (
        "id bigint, dataname string, note string, predicates array<string>, constants array<string>, "
        "logical_expressions array<string>, option_analysis array<struct<preconditions:array<string>,"
        "deduction_steps:array<struct<expression:string>>>>"
    )
    rows = [(i, "a" if i < 30 else "b", "n", ["p"] * i, [], ["((x))"] * (i % 4), None) for i in range(40)]
    df = spark.createDataFrame(rows, ddl)
    whole = score_items(df)
    assert whole.columns == [*df.columns, "score_log", "score_norm"] and whole.count() == 40
    by_group = score_items(df, group_cols=["dataname"], keep=["id"])
    assert by_group.columns == ["id", "dataname", "score_log", "score_norm"]
    ordered = sorted(whole.collect(), key=lambda r: r.score_log)
    norms = [r.score_norm for r in ordered]
    assert norms == sorted(norms)
    once = score_items(df, stats=score_stats(whole))
    assert {r.id: round(r.score_norm, 9) for r in once.collect()} == {
        r.id: round(r.score_norm, 9) for r in whole.collect()
    }
    empty = score_items(df.filter("id < 0"))
    assert empty.collect() == []


def test_histograms(spark):
    rows, df = scored(spark)
    expected = np.histogram([r[2] for r in rows], bins=np.array(B.UNIFORM_EDGES))[0]
    found = N.histogram(df).orderBy("bin").collect()
    assert [r["count"] for r in found] == list(expected) and found[-1].closed_right
    by = N.histogram_by(df, ["dataname"])
    assert by.count() == 20 * len({r[0] for r in rows})
    merged = N.merge_histograms(by).collect()
    assert [r["count"] for r in merged] == list(expected)
    again = N.histogram_from_midpoints(N.merge_histograms(by)).orderBy("bin").collect()
    assert sum(r["count"] for r in again) == len(rows)
    none = N.histogram(df.filter("id < 0")).collect()
    assert len(none) == 20 and sum(r["count"] for r in none) == 0


def pick(rows, n):
    bins = {}
    for name, i, s, _ in sorted(rows, key=lambda r: r[1]):
        floored = math.floor(s * 100) / 100
        bins.setdefault(sum(floored >= e for e in B.CUSTOM_EDGES[1:-1]), []).append(i)
    return {i for members in bins.values() for i in members[:n]}


def test_select_per_bin(spark):
    rows, df = scored(spark, n=2000)
    chosen = N.select_per_bin(df, n=5)
    assert {r.id for r in chosen.collect()} == pick(rows, 5)
    hashed = N.select_per_bin(df, n=5, seed=1).collect()
    again = N.select_per_bin(df.repartition(5), n=5, seed=1).collect()
    other = N.select_per_bin(df, n=5, seed=2).collect()
    assert {r.id for r in hashed} == {r.id for r in again} != {r.id for r in other}
    assert len(hashed) == len(pick(rows, 5))
    report = N.selection_report(df, n=5).collect()
    assert {r.actual_total for r in report} == {len(hashed)} and report[0].expected_total == 80
    grouped = N.selection_report(df, n=5, within=["dataname"])
    assert grouped.count() == 16 * len({r[0] for r in rows})


def test_error_rate(spark):
    rows = [("a", "a", 0.0), ("a", "b", 0.05), ("a", None, 0.06), ("a", "b", None), ("a", "a", 1.0)]
    df = spark.createDataFrame(rows, "label string, predict string, score_norm double")
    found = {r.bin: (r.total, r.errors, r.error_rate) for r in N.error_rate(df).collect()}
    assert len(found) == 20
    assert found["0.00-0.05"] == (2, 1, 0.5) and found["0.05-0.10"] == (1, 1, 1.0)
    assert found["0.95-1.00"] == (1, 0, 0.0) and found["0.10-0.15"] == (0, 0, 0.0)
    logs = N.error_rate_log(df.withColumnRenamed("score_norm", "score_log")).collect()
    assert [r.bin for r in sorted(logs, key=lambda r: r.bin_index)][:2] == ["0-1", "1-2"]


def test_bands_exclude_one(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.5,), (1.0,)], "score_norm double")
    found = N.band_distribution(df).orderBy("lower").collect()
    assert [(r["count"], r.percent) for r in found] == [(1, 25.0)] * 3
    assert N.bucket_members(df, 3).count() == 3


def test_metrics(spark):
    pairs = [("yes", "yes"), ("yes", "no"), ("no", "no"), ("no", "maybe"), ("uncertain", "no"), ("2", "0")]
    df = spark.createDataFrame([("m", *p) for p in pairs], "model string, label string, predict string")
    (row,) = M.metrics(df, ["model"]).collect()
    # classes 0, 1, 2 over the four usable rows
    assert (row.n_total, row.n_used, row.accuracy) == (6, 4, 0.5)
    assert row.precision == pytest.approx((1 / 3 + 1 + 0) / 3)
    assert row.recall == pytest.approx((1 + 1 / 2 + 0) / 3)
    assert row.f1_score == pytest.approx((2 / 4 + 2 / 3 + 0) / 3)
    assert M.metrics(df.filter("label = 'uncertain'"), ["model"]).collect() == []


def test_classification_report(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", None), ("c", "a")]
    df = spark.createDataFrame(pairs, "label string, predict string")
    found = {r["class"]: r for r in M.classification_report(df).collect()}
    assert (found["a"].precision, found["a"].recall, found["a"].support) == (0.5, 0.5, 2)
    assert (found["c"].precision, found["c"].recall, found["c"].f1_score) == (0.0, 0.0, 0.0)
    assert found["accuracy"].f1_score == 0.4 and found["accuracy"].support == 5
    assert found["macro avg"].recall == pytest.approx(round((0.5 + 0.5 + 0) / 3, 4))
    assert found["weighted avg"].recall == pytest.approx(0.4)


def test_upsert(spark):
    ddl = "id bigint, v string, ordinal bigint"
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (1, "c", 2), (None, "d", 3)], ddl)
    source = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (9, "z", 2), (None, "n", 3)], ddl)
    once = J.upsert(target, source, ["id"])
    rows = [(r.id, r.v) for r in once.orderBy("ordinal").collect()]
    assert rows == [(1, "y"), (2, "b"), (1, "c"), (None, "d")]
    twice = J.upsert(once, source, ["id"])
    assert [(r.id, r.v) for r in twice.orderBy("ordinal").collect()] == rows


def test_upsert_files(spark):
    ddl = "file_name string, id bigint, v string, ordinal bigint"
    target = spark.createDataFrame([("a.json", 1, "a", 0), ("b.json", 1, "b", 1)], ddl)
    repairs = spark.createDataFrame([("a_error.json", 1, "x", 0), ("c_error.json", 1, "y", 1), ("b.json", 1, "n", 2)], ddl)
    found = J.upsert_files(target, repairs).orderBy("ordinal").collect()
    assert [(r.file_name, r.v) for r in found] == [("a.json", "x"), ("b.json", "b")]
    assert [tuple(r) for r in J.pair_files(repairs, target).collect()] == [("a.json", "a_error.json")]


def test_attach_scores_needs_equal_lengths(spark):
    _, df = scored(spark, n=10)
    predictions = spark.range(10).withColumn("label", F.lit("a"))
    joined = J.attach_scores(predictions, df.withColumnRenamed("id", "item"), ["id"], ["item"])
    assert all(r.position == r.id for r in joined.collect())
    with pytest.raises(ValueError, match="9 predictions but 10"):
        J.attach_scores(predictions.filter("id < 9"), df, ["id"], ["id"])


def test_dedup(spark):
    rows = [(2, "A  b", "q"), (1, "a B ", "Q"), (3, "a b", "r"), (4, None, None), (5, "", "")]
    df = spark.createDataFrame(rows, "id bigint, context string, question string")
    assert sorted(r.id for r in dedup_items(df, row_key=["id"]).collect()) == [1, 3, 4]
    clash = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "x"), ("b", 2, "unique"), (None, 2, "x"), (None, 3, "alone")],
        "dataname string, id bigint, context string",
    ).withColumn("question", F.lit(""))
    found = {(r.dataname, r.id) for r in dedup_items(clash).collect()}
    # a missing name sorts first, so its row is the first of the equal ones
    assert found == {(None, 2), ("b", 2), (None, 3)}
    composite = dedup_items(df.withColumn("dataname", F.lit("d")), row_key=["dataname", "id"])
    assert sorted(r.id for r in composite.collect()) == [1, 3, 4]


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_split(spark, mode):
    _, df = scored(spark, n=2000)
    out = J.split_train_eval(df, mode, eval_df=df.limit(5))
    n = {r.role: r["count"] for r in out.groupBy("role").count().collect()}
    if mode == 0:
        assert n == {"train": 2000}
    elif mode == 2:
        assert n == {"train": 2000, "eval": 5}
    else:
        assert sum(n.values()) == 2000 and 140 < n["eval"] < 260
        exact = J.split_train_eval(df.limit(1995), 1, exact=True)
        assert exact.filter("role = 'eval'").count() == 200


def test_generation_failures_keep_rows(spark):
    def make():
        def generate(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("model failed")
            return [p.upper() for p in prompts]

        return generate

    rows = [(i, "bad" if i == 3 else None if i == 5 else f"p{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "id bigint, prompt string").coalesce(1)
    found = {r.id: (r.generated_text, r.error) for r in generate_batch(df, make, batch_size=2).collect()}
    assert len(found) == 8 and found[0] == ("P0", None)
    assert found[2] == ("P2", None) and found[5] == (None, None)
    assert found[3] == (None, "RuntimeError: model failed")
    short = generate_batch(df, lambda: lambda prompts: prompts[1:]).collect()
    assert all("texts" in r.error for r in short if r.prompt is not None)


def test_schema_names(spark):
    df = typed_cast(spark.createDataFrame([("1", 2)], "id string, answer int"), EXTRACTED)
    assert df.schema.names == EXTRACTED.names and df.first().id == 1 and df.first().answer == "2"
    spaced = to_file_names(df)
    assert "Logical Expressions" in spaced.columns and from_file_names(spaced).columns == df.columns
    assert file_schema(EXTRACTED).names == spaced.columns


# -- plans ---------------------------------------------------------------------


def test_limits():
    limits = [round(x, 4) for x in Curriculum().limits()]
    assert limits == [
        0.3, 0.405, 0.4913, 0.5625, 0.6216, 0.6708, 0.7119, 0.7465,
        0.7756, 0.8003, 0.8213, 0.8392, 0.8906, 0.93, 0.958, 0.9765,
    ]


def test_stages(spark):
    found = [r[0] for r in spark.range(18).orderBy("id").select(stage_of_epoch(F.col("id"))).collect()]
    assert found == [0] * 3 + [1] * 4 + [2] * 4 + [3] * 7


def brute_draws(spark, rows, weights, epochs, seed):
    """Prefix sums over all items, one binary search per draw, with the same hash."""
    from bisect import bisect_right
    from hashlib import md5

    rows = sorted(rows, key=lambda r: r[:2])
    ends, total = [], 0
    for r in rows:
        total += weights(r)
        ends.append(total)
    out = set()
    for e in epochs:
        for p in range(len(rows)):
            u = int(md5(f"{seed}|{e}|{p}".encode()).hexdigest()[:30], 16) % total
            out.add((e, p, *rows[bisect_right(ends, u)][:2]))
    return out


@pytest.mark.parametrize("skew", ["uniform", "one heavy", "many tiny", "zeros"])
def test_weighted_draws(spark, skew):
    rows, _ = scored(spark, n=400)
    change = {
        "uniform": lambda i, s: s,
        "one heavy": lambda i, s: 1.0 if i == 250 else 1e-6,
        "many tiny": lambda i, s: 1e-6 if i < 380 else s,
        "zeros": lambda i, s: 0.0 if i % 2 else s,
    }[skew]
    rows = [(d, i, change(i, s), l) for d, i, s, l in rows]
    df = spark.createDataFrame(rows, "dataname string, id bigint, score_norm double, score_log double")
    found = P.plan_weighted(df, epochs=3, seed=5).collect()
    assert len(found) == 3 * 400
    drawn = {(r.epoch, r.position, r.dataname, r.id) for r in found if r.epoch}
    weigh = lambda r: int(math.floor((r[2] + 1e-6) * 1_000_000 + 0.5))
    assert drawn == brute_draws(spark, rows, weigh, [1, 2], 5)
    first = sorted((r for r in found if r.epoch == 0), key=lambda r: r.position)
    assert [(r.dataname, r.id) for r in first] == sorted(r[:2] for r in rows)


def test_draws_beyond_the_range_of_a_long(spark):
    rows, df = scored(spark, n=60)
    found = P.plan_weighted(df, epochs=3, seed=5, scale=10**18).collect()
    weigh = lambda r: int(math.floor((r[2] + 1e-6) * 1e18 + 0.5))
    assert sum(map(weigh, rows)) > 2**63
    drawn = {(r.epoch, r.position, r.dataname, r.id) for r in found if r.epoch}
    assert drawn == brute_draws(spark, rows, weigh, [1, 2], 5)


def test_selection_keeps_null_groups_and_breaks_ties(spark):
    rows = [(None if i % 3 == 0 else "d", i // 2, 0.5, i) for i in range(12)]
    df = spark.createDataFrame(rows, "dataname string, id bigint, score_norm double, n int")
    found = N.select_per_bin(df, n=2, within=["dataname"], row_key=["dataname", "id", "n"]).collect()
    assert {(r.dataname, r.n) for r in found} == {(None, 0), (None, 3), ("d", 1), ("d", 2)}
    found = N.select_per_bin(df, n=3, row_key=["dataname", "id", "n"]).collect()
    assert {r.n for r in found} == {0, 1, 3}
    assert N.select_per_bin(df, n=3, row_key=["dataname", "id", "n"], salts=1).count() == 3


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "k int, v int")
    for r in O.running_sum(df, ["k"], "v", "before").collect():
        assert r.before == sum(i % 7 for i in range(r.k))


def test_staged_plan(spark):
    rows, df = scored(spark, n=300)
    found = {(r.epoch, r.position, r.dataname, r.id) for r in P.plan_staged(df, epochs=8, seed=2).collect()}
    expected = set()
    for stage, epochs in ((0, [0, 1, 2]), (1, [3, 4, 5, 6]), (2, [7])):
        w = (1.0, 0.8, 0.6, 0.4)[stage]

        def weigh(r):
            return round(1e6 * (w * 2.5 if r[2] >= 0.7 else w * 1.5 if r[2] >= 0.5 else 1.0))

        expected |= brute_draws(spark, rows, weigh, epochs, 2)
    assert found == expected
    weights = [r[0] for r in df.orderBy("id").select(staged_weight(F.col("score_norm"), 1)).collect()]
    assert set(weights) == {1.0, 0.8 * 1.5, 2.0}


def test_plan_is_the_same_for_any_partitioning(spark):
    _, df = scored(spark, n=300)
    runs = []
    for n in (1, 6):
        spark.conf.set("spark.sql.shuffle.partitions", str(n * 2))
        for method in P.METHODS:
            plan = P.sampling_plan(df.repartition(n), method, epochs=4, seed=9).collect()
            runs.append((method, sorted(tuple(r) for r in plan)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    half = len(P.METHODS)
    assert runs[:half] == runs[half:]
    with pytest.raises(ValueError):
        P.sampling_plan(df, "other")


def test_curriculum(spark):
    rows, df = scored(spark, n=400)
    settings = Curriculum()
    scores = np.array([r[2] for r in rows])
    limits = settings.limits()
    used = [x if (scores <= x).mean() >= 0.3 else np.quantile(scores, 0.3) for x in limits]
    assert P.curriculum_limits(df) == pytest.approx(used)
    plan = P.plan_curriculum(df, seed=1).collect()
    for e, x in enumerate(used):
        mine = [r for r in plan if r.epoch == e]
        n = int((scores <= x).sum())
        extra = int(0.1 * n) if limits[e] < 0.8 else 0
        assert sorted(r.position for r in mine) == list(range(n + extra))
        assert {r.id for r in mine if r.position < n} == {r[1] for r in rows if r[2] <= x}
        assert all(rows[r.id][2] > 0.7 for r in mine if r.position >= n)
    low = df.withColumn("score_norm", F.col("score_norm") * 0.5)
    assert P.curriculum_oversample(low).count() == 0
    assert P.score_quantile(df.filter("id < 0"), 0.3) is None


# -- plan shapes ---------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_single_task_window_or_cross_join(spark):
    rows, df = scored(spark)
    frames = {
        "position": O.with_position(df, ["score_norm", "id"]),
        "select": N.select_per_bin(df, n=3, within=["dataname"]),
        "weighted": P.plan_weighted(df, epochs=3),
        "curriculum": P.plan_curriculum(df),
        "upsert": J.upsert(df.withColumn("ordinal", F.col("id")), df.withColumn("ordinal", F.col("id"))),
        "metrics": M.metrics(df.select("dataname", F.lit("1").alias("label"), F.lit("1").alias("predict")), ["dataname"]),
        "dedup": dedup_items(df.withColumns({"context": F.lit("a"), "question": F.lit("b")})),
        "normalise": normalise(df.drop("score_norm")),
    }
    for name, frame in frames.items():
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        for line_no, line in enumerate(lines := plan.splitlines()):
            if "SinglePartition" in line:
                # only below a global aggregate or the offsets of range partitions
                around = "\n".join(lines[max(0, line_no - 4) : line_no + 3])
                assert "HashAggregate(keys=[]" in around or "_part" in around, (name, around)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from checks import QUERIES

    plan = plan_of(QUERIES["filter_min_id"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,128)]" in plan
    assert "lang" not in plan.split("ReadSchema")[1]
    plan = plan_of(QUERIES["exclude_dataset"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan




def test_bins_do_not_repeat_the_score(spark):
    """A filter on the bin would be pushed down and repeat the score once per edge."""
    _, df = scored(spark)
    made = normalise(df.drop("score_norm")).withColumns({"label": F.lit("a"), "predict": F.lit("b")})
    for frame in (N.histogram(made), N.histogram_by(made, ["dataname"]), N.error_rate(made)):
        assert max(line.count("EXP(") for line in plan_of(frame).splitlines()) <= 4
