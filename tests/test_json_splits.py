"""JSON documents read over many splits, against the whole text parsed at once."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.operators.ordering import assign_ids
from gradus.sources import documents as D
from gradus.sources import readers as R
from tests.test_sources import put

TRICKY = ['plain', 'a } b', '{"x": [1, "}"]}', 'q " \\" \\\\', "\\", "line\nend\r\n", "]}],[{", "é 日 🎉", "", "}" * 300]


def entries(n):
    rng = np.random.default_rng(4)
    return [
        {"context": " ".join(rng.choice(TRICKY, rng.integers(0, 40))), "question": f"q{i}",
         "answers": [str(x) for x in rng.choice(TRICKY, rng.integers(0, 3))], "label": i,
         "more": {"deep": [[{"question": "no"}], {}]}}
        for i in range(n)
    ]


@pytest.fixture(params=[100_000, 0])
def splits(request, spark, monkeypatch):
    """Small splits; their states broadcast or joined."""
    monkeypatch.setattr("gradus.sources.splits.BROADCAST_SPLITS", request.param)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_over_many_splits(spark, tmp_path, splits, indent):
    made = entries(400)
    made[7]["context"] = "long } " * 9000
    put(tmp_path, "a/train.json", " \n" + json.dumps(made, indent=indent, ensure_ascii=False) + "\n")
    put(tmp_path, "b/val.json", json.dumps(made[:3], indent=indent))
    assert R.scan_files(spark, str(tmp_path / "a"), ".json").rdd.getNumPartitions() > 5 or indent is None
    raw = R.read_json_array_mcqa(spark, str(tmp_path), "arrays", max_options=None)
    items = assign_ids(R.accepted(raw)).orderBy("id").collect()
    assert [(r.context, r.question, r.options, r.answer) for r in items] == [
        (e["context"], e["question"], e["answers"], str(e["label"])) for e in [*made, *made[:3]]
    ]
    assert R.rejected(raw).count() == 0


def test_samples_of_one_document_over_many_splits(spark, tmp_path, splits):
    samples = [
        {"context": e["context"], "qa_pairs": [{"question": f"{i}", "answer": a} for a in ("yes", "no")[: i % 3]]}
        for i, e in enumerate(entries(300))
    ]
    other = [{"context": "not", "qa_pairs": [{"question": "these", "answer": "no"}]}] * 200
    document = {"note": {"x": [1, {"y": {}}]}, "before": other, "data_samples": samples, "after": other, "end": "}"}
    put(tmp_path, "first_order_logic/x.json", json.dumps(document, indent=1))
    put(tmp_path, "y.json", json.dumps({"data_samples": []}))
    put(tmp_path, "z.json", json.dumps({"other": other[:1]}))
    raw = R.read_nested_qa(spark, str(tmp_path), "nested")
    items = assign_ids(R.accepted(raw)).orderBy("id").collect()
    expected = [(s["context"], q["question"], q["answer"]) for s in samples for q in s["qa_pairs"]]
    assert [(r.context, r.question, r.answer) for r in items] == expected
    assert R.rejected(raw).count() == 0 and {r.reasoning_type for r in items} == {"FOL"}


def test_broken_files_are_rejected_whole(spark, tmp_path, splits):
    made = entries(200)
    text = json.dumps(made, ensure_ascii=False)
    texts = {
        "cut.json": text[:-1], "half.json": text[: len(text) // 2], "comma.json": text.replace('}, {"context"', '} {"context"', 1),
        "two.json": '{"question": "a"}{"question": "b"}', "scalars.json": '[1, {"question": "a"}]', "text.json": '"x"',
        "open.json": '{"question": "a"', "more.json": '[{"question": "a"}] x', "number.json": "17", "brace.json": "}",
        "nothing.json": "[]", "one.json": ' {"question": "one"} ', "wrong.json": '[{"question": "in"}, {"question": }, ["x"]]',
        "single.json": "[{'question': 'a'}]",
    }
    for name, content in texts.items():
        put(tmp_path, name, content)
    raw = R.read_union_folder(spark, str(tmp_path), "question string")
    rows = raw.collect()
    assert sorted(r.question for r in rows if r.reject_reason is None) == ["in", "one"]
    found = {}
    for r in sorted(rows, key=lambda r: (r._file, r._block, r._row)):
        if r.reject_reason is not None:
            assert r.reject_reason == "invalid JSON"
            name = r._file.rsplit("/", 1)[1]
            found[name] = found.get(name, "") + r.raw
    good = {"nothing.json", "one.json", "wrong.json"}
    expected = {n: t for n, t in texts.items() if n not in good}
    expected["wrong.json"] = '{"question": }["x"]'
    expected["single.json"] = "{'question': 'a'}"
    assert found == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a"\\{}[]', max_size=60))
def test_escapes(text):
    at, _ = D.events(np.frombuffer(text.encode(), dtype=np.uint8))
    expected, slashes = [], 0
    for i, c in enumerate(text):
        if c == "\\":
            slashes += 1
            continue
        if c in '"{}[]' and slashes % 2 == 0:
            expected.append(i)
        slashes = 0
    assert at.tolist() == expected


def test_files_of_one_split_are_read_once(spark, tmp_path, monkeypatch):
    """Their states are known, so none is looked for; endings and broken files come out as in splits."""
    texts = {
        "a.json": json.dumps(entries(30)), "b.json": " \n" + json.dumps(entries(3), indent=1) + "\n",
        "c.json": '{"question": "one"}', "d.json": '{"question": "two"}\n', "e.json": "[]", "f.json": "17",
        "g.json": '{"question": "x"', "h.json": '[{"question": "y"},', "i.json": '{"question": "z"}}', "j.json": " \n",
    }
    for name, text in texts.items():
        put(tmp_path, name, text)
    chained, states = D.chained, []

    def counted(summaries, *more):
        states.append(summaries.count())
        return chained(summaries, *more)

    monkeypatch.setattr(D, "chained", counted)
    ddl = "question string"

    def read():
        return sorted((r.question or "", r.reject_reason or "", r.raw or "") for r in R.read_union_folder(spark, str(tmp_path), ddl).collect())

    once = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    in_splits = read()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert states[0] == 0 and states[1] > 3
    good = lambda rows: [r for r in rows if not r[1]]
    assert good(once) == good(in_splits) and len(good(once)) == 35
    bad = sorted(r[2] for r in once if r[1])
    assert bad == sorted(texts[k] for k in ("f.json", "g.json", "h.json", "i.json", "j.json"))


def test_array_files_hold_as_many_records_as_they_say(spark):
    from checks.q_sources import ARRAY_CHUNK, chunked
    from pyspark.sql import functions as F

    rows = [(i, f"src{i % 20}", "t") for i in range(3 * ARRAY_CHUNK)]
    made = chunked(spark.createDataFrame(rows, "doc_id long, source string, text string"), F.struct("doc_id"))
    assert [r.n for r in made.select(F.size("entries").alias("n")).collect()] == [ARRAY_CHUNK] * 3
