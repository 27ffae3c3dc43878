"""Readers and sinks on small files in the native layouts."""

import json

import pytest
from pyspark.sql import functions as F

from gradus.operators.ordering import assign_ids, with_position
from gradus.sources import readers as R
from gradus.sources import sinks as K


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def block(letter, k):
    head = f"{letter}\n" if letter else ""
    return f"\n{head}context {k}\nquestion {k}\nA.one\nB. two\n C.three \nfour\n"


def test_text_blocks(spark, tmp_path):
    put(tmp_path, "a/x_Train.txt", "".join(block("aB-e"[k % 4].strip("-"), k) for k in range(8)))
    put(tmp_path, "b/dev.txt", block("c", 8) + "\nx\nonly context\n")
    put(tmp_path, "b/ignored.json", "{}")
    raw = R.read_text_blocks(spark, str(tmp_path), "blocks")
    items = assign_ids(R.accepted(raw)).orderBy("id").collect()
    assert [r.id for r in items] == list(range(1, 10))
    assert [r.context for r in items] == [f"context {k}" for k in range(9)]
    assert [r.answer for r in items] == ["0", "1", "", "", "0", "1", "", "", "2"]
    assert items[0].options == ["one", "two", "three", "four"]
    assert [r.split for r in items] == ["train"] * 8 + ["dev"]
    (bad,) = R.rejected(raw).collect()
    assert "only context" in bad.raw and bad.reject_reason.startswith("block")


def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_keep_their_order_over_many_splits(spark, tmp_path, end):
    n = 3000
    parts = []
    for k in range(n):
        text = block("a" if k % 3 else "", k)
        # every second block follows the one before without a blank line
        parts.append(text.removeprefix("\n") if k % 2 else text.replace(" C.three ", " \t") + " ")
    put(tmp_path, "train.txt", "".join(parts).replace("\n", end))
    small_splits(spark)
    try:
        assert R.scan_files(spark, str(tmp_path), ".txt").rdd.getNumPartitions() > 5
        raw = R.read_text_blocks(spark, str(tmp_path), "blocks")
        items = assign_ids(R.accepted(raw)).select("id", "context", "options", "answer").collect()
        shuffled = assign_ids(R.accepted(raw).repartition(3)).select("id", "context").collect()
        assert R.rejected(raw).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = {(k + 1, f"context {k}") for k in range(n)}
    assert {(r.id, r.context) for r in items} == expected == {(r.id, r.context) for r in shuffled}
    for r in items:
        third = "three" if (r.id - 1) % 2 else ""
        assert r.options == ["one", "two", third, "four"] and r.answer == ("0" if (r.id - 1) % 3 else "")


def test_ids_in_scan_order_need_no_shuffle(spark, tmp_path):
    put(tmp_path, "train.txt", "".join(json.dumps({"text": f"c{k}", "question": "q"}) + "\n" for k in range(4000)))
    small_splits(spark)
    try:
        raw = R.read_jsonl_mcqa(spark, str(tmp_path), "lines")
        assert raw.rdd.getNumPartitions() > 5
        ids = assign_ids(R.accepted(raw))
        plan = ids._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan.split("BroadcastExchange")[0]
        found = {(r.id, r.context) for r in ids.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {(k + 1, f"c{k}") for k in range(4000)}


def test_all_options_can_be_kept(spark, tmp_path):
    put(tmp_path, "a.txt", json.dumps({"text": "c", "question": "q", "options": list("abcdef"), "answer": "5"}))
    cut = R.read_jsonl_mcqa(spark, str(tmp_path), "d").first()
    assert cut.options == list("abcd") and cut.n_options == 6
    assert R.read_jsonl_mcqa(spark, str(tmp_path), "d", max_options=None).first().options == list("abcdef")


def test_array_entries_on_lines(spark, tmp_path):
    entries = [{"context": f"c{i}", "question": "q", "answers": ["a"], "label": i} for i in range(50)]
    put(tmp_path, "a.json", "[\n" + ",\n".join(map(json.dumps, entries)) + "\n]\n")
    for lines in (False, True):
        rows = R.accepted(R.read_json_array_mcqa(spark, str(tmp_path), "d", lines=lines)).collect()
        assert {(r.context, r.answer) for r in rows} == {(f"c{i}", str(i)) for i in range(50)}


def test_predictions_are_found_where_they_are_written(spark, tmp_path):
    rows = [("d", "m1", "yes", "no"), ("d", "m2", "1", None), ("e", "m1", "0", "0")]
    df = spark.createDataFrame(rows, "dataset string, model string, label string, predict string")
    K.write_predictions(df, str(tmp_path))
    put(tmp_path, "d/m3/generated_predictions.jsonl", '{"label": "a", "predict": "b"}\nbroken\n')
    roots = {d: str(tmp_path / d) for d in ("d", "e")}
    found = R.read_predictions_tree(spark, roots).select("dataset", "model", "label", "predict").collect()
    assert {tuple(r) for r in found} == {*rows, ("d", "m3", "a", "b")}
    bad = R.rejected_predictions(R.read_predictions_tree(spark, roots, keep_bad=True)).collect()
    assert [(r.model, r.raw) for r in bad] == [("m3", "broken")]
    said = []
    R.read_predictions_folders(spark, [str(tmp_path / "none"), roots["e"]], report=said.append)
    assert len(said) == 1 and "none" in said[0]


def test_jsonl_mcqa(spark, tmp_path):
    lines = [
        json.dumps({"text": "t", "question": "q", "options": list("abcde"), "answer": 2}),
        "",
        "{broken",
        json.dumps({"context": "unused", "options": "none"}),
        json.dumps({"text": "u", "options": None, "answer": "x"}),
    ]
    put(tmp_path, "mcqa_dev.txt", "\n".join(lines))
    raw = R.read_jsonl_mcqa(spark, str(tmp_path), "lines")
    items = {r.context: r for r in R.accepted(raw).collect()}
    assert items["t"].options == list("abcd") and items["t"].answer == "2"
    assert items["t"].split == "dev" and items["t"].question == "q"
    assert items[""].options == [] and items["u"].options == [] and items["u"].answer == "x"
    (bad,) = R.rejected(raw).collect()
    assert bad.raw == "{broken"
    assert (R.accepted(raw).count(), R.rejected(raw).count()) == (3, 1)
    yes_no = R.accepted(R.read_jsonl_mcqa(spark, str(tmp_path), "lines", task_type="BQA"))
    assert {tuple(r.options) for r in yes_no.collect()} == {()}


def test_json_array(spark, tmp_path):
    entries = [
        {"context": "c1", "question": "q", "answers": list("abcde"), "label": 3},
        {"context": "c2", "question": "q", "answers": ["a"]},
    ]
    put(tmp_path, "val.json", json.dumps(entries, indent=2))
    items = R.accepted(R.read_json_array_mcqa(spark, str(tmp_path), "arrays")).collect()
    found = {r.context: (r.options, r.answer, r.split) for r in items}
    assert found == {"c1": (list("abcd"), "3", "dev"), "c2": (["a"], "", "dev")}


def test_premises(spark, tmp_path):
    rows = [
        {"premises": ["a.", "b."], "conclusion": "c", "label": "Uncertain"},
        {"premises": [], "conclusion": "d", "label": True},
        {"conclusion": "e", "label": "False"},
    ]
    put(tmp_path, "premises_validation.jsonl", "\n".join(map(json.dumps, rows)))
    items = R.accepted(R.read_jsonl_premises(spark, str(tmp_path), "premises")).collect()
    found = {r.question: (r.context, r.answer, r.split, r.options) for r in items}
    assert found == {
        "c": ("a. b.", "uncertain", "test", []),
        "d": ("", "", "test", []),
        "e": ("", "no", "test", []),
    }


def test_nested(spark, tmp_path):
    document = {
        "data_samples": [
            {"context": "c1", "qa_pairs": [{"question": "q1", "answer": "yes"}, {"question": "q2"}]},
            {"context": "c2", "qa_pairs": []},
            {"context": "c3", "qa_pairs": [{"question": "q3", "answer": "no"}]},
        ]
    }
    put(tmp_path, "first_order_logic/x.json", json.dumps(document))
    put(tmp_path, "misc/y.json", json.dumps(document))
    raw = R.read_nested_qa(spark, str(tmp_path), "nested")
    items = assign_ids(R.accepted(raw)).orderBy("id").collect()
    moved = assign_ids(R.accepted(raw).repartition(4)).orderBy("id").collect()
    assert [r.question for r in moved] == [r.question for r in items]
    assert [(r.id, r.context, r.question, r.answer) for r in items[:3]] == [
        (1, "c1", "q1", "yes"), (2, "c1", "q2", ""), (3, "c3", "q3", "no"),
    ]
    assert [r.reasoning_type for r in items] == ["FOL"] * 3 + [""] * 3
    assert {r.split for r in items} == {"train"}
    put(tmp_path, "misc/z.json", "[broken")
    (bad,) = R.rejected(R.read_nested_qa(spark, str(tmp_path), "nested")).collect()
    assert bad.raw == "[broken"
    assert R.accepted(R.read_nested_qa(spark, str(tmp_path), "nested")).count() == 6


def test_union_folder(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps([{"id": 1}, {"id": 2}]))
    put(tmp_path, "sub/b.JSON", json.dumps({"id": 3}))
    put(tmp_path, "sub/c.json", "17")
    put(tmp_path, "d.json", "[{")
    whole = R.read_union_folder(spark, str(tmp_path), "id bigint")
    assert whole.filter("reject_reason is null").count() == 3
    raw = whole.collect()
    assert sorted(r.id for r in raw if r.reject_reason is None) == [1, 2, 3]
    assert sorted(r.raw for r in raw if r.reject_reason) == ["17", "[{"]


def test_lenient_lines(spark, tmp_path):
    put(tmp_path, "x.jsonl", '{"id": 1}\nnot json\n{"id": 2}\n{"id": ')
    put(tmp_path, "y.txt", '{"id": 3}')
    assert sorted(r.id for r in R.read_jsonl_lenient(spark, str(tmp_path), "id bigint").collect()) == [1, 2]


def test_counting_lines(spark, tmp_path):
    put(tmp_path, "x.jsonl", '{"id": 1}\nnot json')
    assert R.read_jsonl_lenient(spark, str(tmp_path), "id bigint").count() == 1


def test_predictions(spark, tmp_path):
    lines = '{"label": "yes", "predict": "no"}\n\n{"label": "1", "predict": null}\nbroken\n'
    put(tmp_path, "one/m1/generated_predictions.jsonl", lines)
    put(tmp_path, "one/deep/m2/generated_predictions.jsonl", '{"label": "2", "predict": "2"}')
    put(tmp_path, "two/m1/generated_predictions.jsonl", '{"label": "no", "predict": "no"}')
    put(tmp_path, "one/m1/other.jsonl", lines)
    roots = {"a": str(tmp_path / "one"), "b": str(tmp_path / "two")}
    found = R.read_predictions_tree(spark, roots).collect()
    assert sorted((r.dataset, r.model, r.label) for r in found) == [
        ("a", "m1", "1"), ("a", "m1", "yes"), ("a", "m2", "2"), ("b", "m1", "no"),
    ]
    folders = [str(tmp_path / "two/m1"), str(tmp_path / "none"), str(tmp_path / "one/m1")]
    whole = R.read_predictions_folders(spark, folders)
    ordered = with_position(whole, ["source_rank", *R.SCAN_ORDER]).orderBy("position").collect()
    assert [(r.source_rank, r.label) for r in ordered] == [(0, "no"), (2, "yes"), (2, "1")]
    with pytest.raises(ValueError):
        R.read_predictions_folders(spark, [str(tmp_path / "none")])


def test_globs(spark, tmp_path):
    for name in ("a.json", "b.JSON", "c.jsonl", "d.txt", "s/e.Json"):
        put(tmp_path, name, "x")
    assert R.scan_files(spark, str(tmp_path), ".json").count() == 3
    assert R.scan_files(spark, str(tmp_path), ".json", recursive=False).count() == 2
    assert R.scan_files(spark, str(tmp_path), ".txt").count() == 1


def test_histogram_file(spark, tmp_path):
    from gradus.operators.binning import histogram

    df = spark.createDataFrame([(0.0,), (0.07,), (1.0,)], "score_norm double")
    path = str(tmp_path / "h")
    K.write_lines(K.histogram_lines(histogram(df)), "line_no", "value", path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[:3] == [K.HISTOGRAM_HEADER, "[0.00 - 0.05): 1", "[0.05 - 0.10): 1"]
    assert lines[-1] == "[0.95 - 1.00]: 1" and len(lines) == 21


def test_dataset_folders(spark, tmp_path):
    rows = [(i, "a" if i < 90 else "b", "train", "PL") for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, dataname string, split string, reasoning_type string")
    path = str(tmp_path / "d")
    K.write_dataset(df, path)
    assert (tmp_path / "d" / "dataname=a" / "split=train").is_dir()
    read = spark.read.json(path)
    assert read.count() == 100 and "reasoning type" in read.columns
    K.append_results(df, str(tmp_path / "r"), 1)
    K.append_results(df, str(tmp_path / "r"), 1)
    K.append_results(df.filter("id < 3"), str(tmp_path / "r"), 2)
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("batch").count().count() == 2
    assert spark.read.parquet(str(tmp_path / "r")).count() == 103


def test_metrics_file(spark, tmp_path):
    df = spark.createDataFrame(
        [("d", "m", 0.5, 0.25, 1.0, 0.4, 9)],
        "dataset string, model string, accuracy double, precision double, recall double, f1_score double, n_total int",
    )
    path = tmp_path / "m"
    K.write_metrics(df, str(path))
    (file,) = (path / "dataset=d").glob("*.csv")
    assert file.read_text().splitlines() == ["model,accuracy,precision,recall,f1_score", "m,0.5,0.25,1.0,0.4"]


def test_entry_points_by_name(spark, tmp_path):
    import gradus

    put(tmp_path, "a/train.txt", block("b", 1))
    items = gradus.accepted(gradus.read_items(spark, str(tmp_path / "a"), "text_blocks", "blocks"))
    (asked,) = gradus.build_prompts(items, "extract").collect()
    assert asked.prompt.startswith("System: ") and "context 1" in asked.prompt
    (asked,) = gradus.build_prompts(items, "train").collect()
    assert [m.role for m in asked.prompt] == ["system", "user", "assistant"] and asked.prompt[2].content == "1"
    assert len(gradus.build_prompts(items, "infer").first().prompt) == 2
    for call in (lambda: gradus.read_items(spark, "x", "csv", "d"), lambda: gradus.build_prompts(items, "other")):
        with pytest.raises(ValueError):
            call()


def test_folders_that_cannot_be_read_are_skipped_when_asked(spark, tmp_path):
    put(tmp_path, "good/generated_predictions.jsonl", '{"label": "yes", "predict": "no"}')
    put(tmp_path, "worse/part-1.json.gz", "no gzip")
    folders = [str(tmp_path / n) for n in ("worse", "good")]
    glob, said = "{generated_predictions.jsonl,part-*.json*}", []
    found = R.read_predictions_folders(spark, folders, glob, report=said.append, on_error="skip").collect()
    assert [(r.source_rank, r.label) for r in found] == [(1, "yes")]
    assert len(said) == 1 and "cannot be read" in said[0] and "worse" in said[0]
    with pytest.raises(Exception):
        R.read_predictions_folders(spark, folders, glob).collect()
    with pytest.raises(ValueError):
        R.read_predictions_folders(spark, folders, on_error="ignore")


def test_files_of_a_scan_grow_with_the_table(spark, tmp_path, monkeypatch):
    from checks import q_sources as Q

    rows = [(i, f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(Q, "run_path", lambda *a: str(tmp_path / "scan"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        found = Q.assign_ids_scan_order(spark, str(tmp_path)).orderBy("id").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [(r.id, r.context) for r in found] == [(i + 1, t) for i, t in rows]
    assert len(list((tmp_path / "scan").glob("part-*.json"))) >= 12
