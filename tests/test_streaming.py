"""Incremental runs: resume, retry after failures, frozen statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators.filters import has_context
from gradus.operators.scoring import score_stats
from gradus.sources.commits import read_results
from gradus.streaming.incremental import (
    extract_step,
    finished,
    incremental_extract,
    incremental_score,
    option_step,
)

ITEM = "dataname string, id bigint, context string"


def lists(prompts):
    return ['{"Predicates": ["P"], "Constants": [], "Logical Expressions": ["P(a)"]}' for _ in prompts]


def arrive(spark, folder, name, rows, ddl=ITEM):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, ddl=ITEM):
    return spark.readStream.schema(ddl).option("recursiveFileLookup", "true").parquet(str(folder))


def test_resume_and_retry(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def failing():
        def generate(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return lists(prompts)

        return generate

    arrive(spark, source, "1", [("d", 1, "one"), ("d", 2, " "), ("d", 3, "bad")])
    incremental_extract(
        stream(spark, source), failing, out, state,
        step=lambda df, make: extract_step(df.repartition(3, "id"), make),
    )
    first = {r.id: r for r in read_results(spark, out).collect()}
    assert 2 not in first and first[3].error.startswith("RuntimeError")
    assert first[3].reject_reason == "empty completion"

    # key 1 comes again with key 3 and a new one; only 3 and 4 are generated
    arrive(spark, source, "2", [("d", 1, "one"), ("d", 3, "bad"), ("d", 4, "four")])
    incremental_extract(stream(spark, source), lambda: lists, out, state)
    rows = read_results(spark, out).filter("error is null").collect()
    assert sorted(r.id for r in rows) == [1, 3, 4]
    assert all(r.logical_expressions == ["P(a)"] for r in rows)
    before = read_results(spark, out).count()
    incremental_extract(stream(spark, source), lambda: lists, out, state)
    assert read_results(spark, out).count() == before


def test_option_step(spark):
    ddl = (
        "task_type string, context string, question string, options array<string>, answer string, "
        "predicates array<string>, constants array<string>, logical_expressions array<string>"
    )
    rows = [(t, "c", "q", ["o"], "0", [], [], []) for t in ("MCQA", "BQA", "NLI")]
    text = '{"option_analysis": [{"option_index": 0, "deduction_steps": [{"expression": "P(a)"}]}]}'
    made = option_step(spark.createDataFrame(rows, ddl), lambda: lambda prompts: [text] * len(prompts))
    found = made.collect()
    assert sorted(r.task_type for r in found) == ["BQA", "MCQA"]
    assert all(r.option_analysis[0].deduction_steps[0].expression == "P(a)" for r in found)


def test_score_with_frozen_statistics(spark, tmp_path):
    ddl = (
        "dataname string, id bigint, predicates array<string>, constants array<string>, "
        "logical_expressions array<string>, option_analysis array<struct<preconditions:array<string>,"
        "deduction_steps:array<struct<expression:string>>>>"
    )
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    rows = [("d", i, ["p"] * i, [], ["((a))"], None) for i in range(6)]
    stats = score_stats(spark.createDataFrame([(1.0,), (3.0,)], "score_log double"))
    for n in (1, 2):
        arrive(spark, source, str(n), rows[3 * n - 3 : 3 * n], ddl)
        incremental_score(stream(spark, source, ddl), stats, out, state)
    found = read_results(spark, out)
    assert found.count() == 6
    expected = 1 / (1 + F.exp(-(F.col("score_log") - 2.0) / F.sqrt(F.lit(1.0 + 1e-5))))
    assert found.filter(F.abs(F.col("score_norm") - expected) > 1e-12).count() == 0


def test_blank_context(spark):
    df = spark.createDataFrame([("a",), (" \n　",), (None,)], "context string")
    assert [r[0] for r in df.select(has_context()).collect()] == [True, False, False]


def test_a_new_checkpoint_adds_and_keeps(spark, tmp_path):
    out = str(tmp_path / "out")

    def model(name):
        text = '{"Predicates": ["%s"], "Constants": [], "Logical Expressions": ["P"]}' % name
        return lambda: lambda prompts: [text] * len(prompts)

    for run, rows in (("1", [("d", 1, "one"), ("d", 2, "two")]), ("2", [("d", 2, "two"), ("d", 3, "three")])):
        arrive(spark, tmp_path / run, "x", rows)
        incremental_extract(stream(spark, tmp_path / run), model(run), out, str(tmp_path / f"state{run}"))
    found = {r.id: r.predicates for r in read_results(spark, out).collect()}
    assert found == {1: ["1"], 2: ["1"], 3: ["2"]} and read_results(spark, out).count() == 3


def test_scores_of_another_checkpoint_stay(spark, tmp_path):
    ddl = "dataname string, id bigint, predicates array<string>, constants array<string>, logical_expressions array<string>, " \
        "option_analysis array<struct<preconditions:array<string>,deduction_steps:array<struct<expression:string>>>>"
    stats = score_stats(spark.createDataFrame([(1.0,), (3.0,)], "score_log double"))
    out = str(tmp_path / "out")
    for run, ids in (("1", [1, 2]), ("2", [2, 3])):
        arrive(spark, tmp_path / run, "x", [("d", i, ["p"], [], ["a"], None) for i in ids], ddl)
        incremental_score(stream(spark, tmp_path / run, ddl), stats, out, str(tmp_path / f"s{run}"), partitions=2)
    assert sorted(r.id for r in read_results(spark, out).collect()) == [1, 2, 3]


def test_nothing_finished_is_told_from_a_broken_path(spark, tmp_path):
    assert finished(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        finished(spark, str(tmp_path / "broken"))


def items_of(ids, text="text"):
    return [("d", i, f"{text} {i}") for i in ids]


def notes(spark, out):
    from gradus.sources import commits as C

    noted = C.notes(spark, out)
    return [noted[c.attempt] for c in sorted(C.commits(spark, out).values(), key=lambda c: c.batch)]


def test_a_batch_costs_its_own_size(spark, tmp_path):
    """New keys read no earlier ones, however many there are; repeated ones read their own batch."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for n in range(10):
        # Each batch repeats the last key of the one before.
        arrive(spark, source, str(n), items_of(range(max(0, 50 * n - (n > 0)), 50 * n + 50)))
        incremental_extract(stream(spark, source), lambda: lists, out, state)
    found = [n["keys_read"] for n in notes(spark, out)]
    assert found == [0, *[50] * 9]
    arrive(spark, source, "new", items_of(range(900, 930)))
    incremental_extract(stream(spark, source), lambda: lists, out, state)
    assert notes(spark, out)[-1]["keys_read"] == 0
    rows = read_results(spark, out)
    assert rows.count() == rows.select("id").distinct().count() == 530


def test_filters_lose_no_key(spark, tmp_path, monkeypatch):
    from gradus.sources.commits import commit_batch
    from gradus.streaming import keys as K

    out = str(tmp_path / "out")
    monkeypatch.setattr(K, "CHUNK_KEYS", 300)
    monkeypatch.setattr(K, "ROUND_BYTES", 1)
    sets = {0: range(1000), 1: range(1000, 1100), 2: []}
    for batch, ids in sets.items():
        done = spark.createDataFrame(items_of(ids), ITEM)
        commit_batch(spark, out, "s", batch, f"a{batch}", K.write_keys(done, ("dataname", "id"), out, f"a{batch}"))
    for ids, expected in (([5], 1000), ([1000], 100), ([1, 1001], 1100), (range(0, 1100, 7), 1100)):
        asked = spark.createDataFrame(items_of(ids), ITEM)
        done, read = K.finished_keys(asked, out, ("dataname", "id"))
        assert read == expected and asked.join(done, ["dataname", "id"], "left_anti").count() == 0
        assert K.finished_keys(asked, out, ("dataname", "id"), ("s", 0))[1] == expected % 1000
    strange = spark.createDataFrame([(None, None, "x"), ("d", -1, "y")], ITEM)
    assert K.finished_keys(strange, out, ("dataname", "id")) == (None, 0)


def test_a_crash_leaves_old_rows_or_new_ones(spark, tmp_path, monkeypatch):
    from gradus.sources import commits as C

    out = str(tmp_path / "out")
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    new = old.withColumn("v", F.lit("new"))

    def seen():
        return sorted({r.v for r in C.read_results(spark, out).collect()})

    assert C.read_results(spark, out) is None
    C.append_results(old, out, 3, "s")
    failing = new.withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception):
        C.append_results(failing, out, 3, "s")
    assert seen() == ["old"]
    with monkeypatch.context() as m:
        m.setattr(C, "move", lambda *a: (_ for _ in ()).throw(OSError("killed before the commit")))
        with pytest.raises(OSError):
            C.append_results(new, out, 3, "s")
    assert seen() == ["old"]
    with monkeypatch.context() as m:
        m.setattr(C, "remove", lambda *a: (_ for _ in ()).throw(OSError("killed after the commit")))
        with pytest.raises(OSError):
            C.append_results(new, out, 3, "s")
    assert seen() == ["new"]
    C.append_results(old.limit(1), out, 4, "s")
    C.append_results(new, out, 3, "t")
    found = C.read_results(spark, out)
    assert found.count() == 5 and set(found.columns) == {"id", "v", "stream", "batch"}
    with pytest.raises(ValueError):
        C.read_results(spark, str(tmp_path))


@pytest.mark.parametrize("folder", [False, True])
def test_a_table_is_a_file_or_a_folder(spark, tmp_path, folder):
    """Large tables are folders of files; a stream has the rows of all."""
    from checks.q_streaming import stream as table_stream

    rows = [("d", i, f"text {i}") for i in range(6)] + [("d", 5, "text 5"), (None, None, None)]
    df = spark.createDataFrame(rows, ITEM)
    if folder:
        df.repartition(3).write.parquet(str(tmp_path / "items.parquet"))
    else:
        df.toPandas().astype({"id": "Int64"}).to_parquet(tmp_path / "items.parquet", index=False)
    spark.createDataFrame([("x", 9, "other")], ITEM).write.parquet(str(tmp_path / "other.parquet"))
    query = (
        table_stream(spark, str(tmp_path), "items")
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, found), key=str) == sorted(rows, key=str)


def test_a_batch_prepares_new_rows_only(spark, tmp_path):
    """Neither the keys of a batch nor rows scored before are made ready for scoring."""
    ddl = "dataname string, id bigint, words string"
    stats = score_stats(spark.createDataFrame([(1.0,), (3.0,)], "score_log double"))
    made = spark.sparkContext.accumulator(0)

    def prepare(df):
        def count(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        words = F.split("words", " ")
        step = "array<struct<preconditions:array<string>,deduction_steps:array<struct<expression:string>>>>"
        return df.mapInArrow(count, df.schema).select(
            "dataname", "id", words.alias("predicates"), words.alias("constants"),
            F.array().cast("array<string>").alias("logical_expressions"), F.lit(None).cast(step).alias("option_analysis"),
        )

    out = str(tmp_path / "out")
    for run, ids in (("1", [1, 2, None]), ("2", [2, 3])):
        arrive(spark, tmp_path / run, "x", [("d", i, "a b") for i in ids], ddl)
        incremental_score(stream(spark, tmp_path / run, ddl), stats, out, str(tmp_path / f"s{run}"), 2, prepare=prepare)
    found = read_results(spark, out).collect()
    assert sorted((r.id or 0) for r in found) == [0, 1, 2, 3] and made.value == 4
    assert {round(r.score_log, 9) for r in found} == {round(float(np.log(5)), 9)}
