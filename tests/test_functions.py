"""Column expressions on hand-computed values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.functions import bins as B
from gradus.functions import brackets as K
from gradus.functions import completions as C
from gradus.functions import labels as G
from gradus.functions import prompts as P
from gradus.functions import score as S
from gradus.functions import text as X


def values(spark, ddl, rows, *columns):
    """Evaluate column expressions over rows; one tuple per row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {ddl}")
    out = df.select("_i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("_i")
    return [tuple(r)[1:] for r in out.collect()]


@pytest.mark.parametrize(
    ("expression", "depth", "ops", "step"),
    [
        ("A(b)", 1, 0, 1.0),
        ("T(C(J,W) ∨ N(J,S))", 2, 1, 8.0),
        ("(A) -> ~(B)", 1, 2, 3.0),
        ("a)b((", 1, 0, 1.0),
        ("))((", 1, 0, 1.0),
        ("", 1, 0, 1.0),
        ("N/A", 1, 0, 0.0),
        ("Derivation cannot proceed", 1, 0, 0.0),
        ("Derivation cannot proceed.", 1, 0, 1.0),
        ("  N/A　", 1, 0, 0.0),
        ("`N/A`", 1, 0, 1.0),
        ("{[()]}", 3, 0, 9.0),
        ("([)]", 2, 0, 4.0),
        ("p ← q → r ¬ s ∧ t ~~ -->", 1, 7, 8.0),
        ("->->", 1, 2, 3.0),
        ("- > é ü", 1, 0, 1.0),
    ],
)
def test_expression(spark, expression, depth, ops, step):
    e = F.col("e")
    found = values(
        spark, "e string", [(expression,)], K.nesting_depth(e), K.count_operators(e), S.step_score(e)
    )
    assert found == [(depth, ops, step)]


def test_missing_values(spark):
    e, xs = F.col("e"), F.col("xs")
    rows = [(None, None), (None, []), (None, [None, "((a))"])]
    found = values(
        spark, "e string, xs array<string>", rows, K.nesting_depth(e), S.step_score(e),
        K.average_depth(xs), S.preconditions_score(xs),
    )
    assert found == [(None, 1.0, 1.0, 0.0), (None, 1.0, 1.0, 0.0), (None, 1.0, 2.0, 8.0)]


def test_whole_score(spark):
    analysis = (
        "array<struct<preconditions:array<string>,deduction_steps:array<struct<expression:string>>>>"
    )
    ddl = f"e array<string>, p array<string>, c array<string>, o {analysis}"
    options = [
        (["A(b)", "((c))"], [("N/A",), ("(a) -> (b)",)]),
        None,
        (None, None),
    ]
    rows = [(["T(C(J) ∨ N(S))", "A"], ["p"] * 3, ["c"] * 2, options), (None, None, None, None)]
    e, p, c, o = (F.col(x) for x in "epco")
    found = values(spark, ddl, rows, S.context_score(e, p, c), S.options_score(o), S.raw_log_score(e, p, c, o))
    # context: 2 * 1.5^2 + 3 + 2; options: 2 * 1.5^2 + 0 + 1 * 2
    assert found[0] == (9.5, 6.5, pytest.approx(math.log(17)))
    assert found[1] == (0.0, 0.0, 0.0)


def test_uniform_bins_on_edges(spark):
    """Left-closed like numpy.histogram, right-closed like pandas.cut."""
    x = F.col("x")
    numbers = [i / 100 for i in range(101)] + [i * 0.05 for i in range(21)] + [-0.1, 1.2, 0.123456]
    found = values(
        spark, "x double", [(v,) for v in [*numbers, None, float("nan")]],
        B.bin_index(x, B.UNIFORM_EDGES), B.bin_index(x, B.UNIFORM_EDGES, "right"),
    )
    edges = np.array(B.UNIFORM_EDGES)
    assert list(edges) == list(np.arange(0, 1.05, 0.05)[:21])
    for v, (left, right) in zip(numbers, found):
        hit = np.nonzero(np.histogram([v], bins=edges)[0])[0]
        assert left == (hit[0] if len(hit) else None), v
        cut = pd.cut(pd.Series([v]), edges, labels=False, include_lowest=True)[0]
        assert right == (None if np.isnan(cut) else cut), v
    assert found[-2:] == [(None, None), (None, None)]


def test_floor_and_custom_bins(spark):
    x = F.col("x")
    rows = [(v,) for v in (0.29, 0.57, 0.58, 0.199, 0.2, 0.9, 0.899, 1.0)]
    floored = B.floor_2(x)
    found = values(spark, "x double", rows, floored, B.bin_index(floored, B.CUSTOM_EDGES))
    assert [f[0] for f in found] == [0.28, 0.56, 0.57, 0.19, 0.2, 0.9, 0.89, 1.0]
    assert [f[1] for f in found] == [2, 8, 8, 0, 1, 15, 14, 15]


def test_half_open_bins(spark):
    x = F.col("x")
    rows = [(v,) for v in (0.0, 0.3, 0.7, 0.999, 1.0)]
    index = B.bin_index(x, B.BUCKET_EDGES, last_closed=False)
    assert [f[0] for f in values(spark, "x double", rows, index)] == [0, 1, 3, 3, None]


def test_predictions(spark):
    rows = [
        ("yes", "BQA"), ("No", "BQA"), ("I know", "BQA"), ("maybe", "BQA"), ("yes or no", "BQA"),
        ("10", "MCQA"), ("3 or 1", "MCQA"), ("assistant\n\n2", "MCQA"), ("4", "MCQA"),
        ("yes", "NLI"), (None, "BQA"),
    ]
    t, k = F.col("t"), F.col("k")
    found = values(spark, "t string, k string", rows, G.normalize_prediction(t, k))
    assert [f[0] for f in found] == ["yes", "no", "no", None, "yes", "0", "1", "2", None, None, None]


def test_labels(spark):
    rows = [(x,) for x in ("3", " 2 ", "YES", "no", "uncertain", "-1", "007", "", None)]
    found = values(spark, "x string", rows, G.parse_label(F.col("x")))
    assert [f[0] for f in found] == [3, 2, 1, 0, None, None, 7, None, None]


def test_error_flag(spark):
    rows = [("a", "a"), ("a", "b"), ("a", None), (None, None)]
    found = values(spark, "a string, b string", rows, G.error_flag(F.col("a"), F.col("b")))
    assert [f[0] for f in found] == [False, True, True, True]


def test_field_rules(spark):
    rows = [("A. one",), ("B.two ",), (" C.\tthree\n",), ("E. five",), ("A.",), ("",)]
    found = values(spark, "x string", rows, X.strip_option_letter(F.col("x")))
    assert [f[0] for f in found] == ["one", "two", "three", "E. five", "", ""]
    rows = [("a",), ("D",), ("e",), ("",), (None,)]
    found = values(spark, "x string", rows, X.letter_to_index(F.col("x")))
    assert [f[0] for f in found] == ["0", "3", "", "", ""]
    rows = [("Retrain_dev.txt",), ("val.json",), ("my-TEST.txt",), ("other",)]
    x = F.col("x")
    found = values(
        spark, "x string", rows,
        X.split_from_name(x), X.split_from_name(x, X.SPLIT_RULES["val"], "none"),
    )
    assert found == [("train", "train"), ("", "dev"), ("test", "test"), ("", "none")]
    rows = [("/x/nm_logic/first_order_logic/a.json",), ("/x/y/nm_logic.json",)]
    found = values(spark, "x string", rows, X.reasoning_from_path(x))
    assert [f[0] for f in found] == ["FOL", ""]


LISTS = '{"Predicates": ["`P(x)`: a", "Q"], "constants" : ["c"], Logical Expressions: ["P(c)"]}'


@pytest.mark.parametrize(
    ("text", "lists", "reason"),
    [
        (LISTS, (["`P(x)`: a", "Q"], ["c"], ["P(c)"]), None),
        ("Sure!\n" + LISTS + "\nDone", (["`P(x)`: a", "Q"], ["c"], ["P(c)"]), None),
        (LISTS.replace("Q", "Q(a[1])"), (["`P(x)`: a", "Q(a[1])"], ["c"], ["P(c)"]), None),
        (LISTS.replace('["c"]', '["c", "d'), ([], [], []), C.LISTS_NOT_FOUND),
        (LISTS.replace("constants", "const"), ([], [], []), C.LISTS_NOT_FOUND),
        ("", (None, None, None), C.EMPTY_COMPLETION),
        (None, (None, None, None), C.EMPTY_COMPLETION),
    ],
)
def test_parse_extraction(spark, text, lists, reason):
    ((found,),) = values(spark, "t string", [(text,)], C.parse_extraction(F.col("t")))
    assert (found.predicates, found.constants, found.logical_expressions) == lists
    assert found.reject_reason == reason
    assert found.assistant_content == (text if reason == C.LISTS_NOT_FOUND else None)


def test_parse_extraction_literal(spark):
    text = LISTS.replace("Q", "Q(a[1])")
    ((found,),) = values(spark, "t string", [(text,)], C.parse_extraction(F.col("t"), "literal"))
    assert found.predicates == ["`P(x)`: a"] and found.reject_reason is None


def test_literal_items_are_those_of_the_pattern(spark):
    lists = ["", "[]", '["a"]', '["a", "b"]', '["a" "b"', '[""]', '["a", "", "b"]', '["a[1', '["a", "b', '"', '""', '"""', 'a"b"c']
    rows = spark.createDataFrame([(t,) for t in [*lists, None]], "t string")
    pattern = F.regexp_extract_all("t", F.lit(C.ITEM_PATTERN), 1)
    made = rows.select(C._literal_items(F.col("t")).alias("a"), pattern.alias("b"))
    assert all(r.a == r.b for r in made.collect())
    plan = made.select("a")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" in plan


def test_literal_keys_in_any_case_and_place(spark):
    texts = ['PREDICATES:["p"]', "predicatepredicates : [\"p\"] 'x'", '""predicateſ" :\n["p"]', 'PredIcates: no, "predıcates": ["p"]']
    for text in texts:
        ((found,),) = values(spark, "t string", [(text + ' constants: ["c"] Logical expressionS":[]',)], C.parse_extraction(F.col("t"), "literal"))
        assert (found.predicates, found.constants, found.logical_expressions) == (["p"], ["c"], [])


def test_json_list_escapes_as_one_text_each(spark):
    import json

    lists = [[], ["a"], ["a", "b"], ["a\",", ",", '","', "\\", "\n\t\x01é/"], ["", ""], [""], ["\uf8fe", "x"], ["a", "b\uf8fe"]]
    rows = spark.createDataFrame([(x,) for x in [*lists, None, ["a", None]]], "t array<string>")
    found = [r[0] for r in rows.select(P.json_list(F.col("t"))).collect()]
    assert found[:-2] == [json.dumps(x, ensure_ascii=False) for x in lists]
    assert found[-2:] == ["[]", '["a", ""]']
    plan = rows.select(P.json_list(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json(array(array_join(" in plan


def test_each_list_is_parsed_once(spark):
    df = spark.createDataFrame([("x",)], "t string").select(C.parse_extraction(F.upper("t")).alias("p")).select("p.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract(") == 3 and plan.count("upper(") == 1
    df = spark.createDataFrame([("x",)], "t string").select(C.parse_option_analysis(F.upper("t")).alias("p")).select("p.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_json(") == 1 or plan.count("jsontostructs(") == 1


def test_completion_of_a_single_struct(spark):
    df = spark.createDataFrame([((" a ",),), (None,)], "c struct<generated_text:string>")
    assert [r[0] for r in df.select(C.completion_text(F.col("c"), many=False)).collect()] == ["a", ""]


ONE = (
    '{"option_index": 0, "option_text": "t {", "preconditions": ["P(a)"], "deduction_target": "Q(a)", '
    '"deduction_steps": [{"step": 1, "task": "k", "expression": "`P(a)`", "result": "r"}], '
    '"is_correct": true}'
)


@pytest.mark.parametrize(
    ("text", "wrapped", "literal"),
    [
        ('{"option_analysis": [' + ONE + "]}", 1, 0),
        ('Here: {"option_analysis": [' + ONE + ", " + ONE + "]} Bye }", 2, 0),
        ('{"option_analysis": [' + ONE, C.ANALYSIS_NOT_JSON, 0),
        ('{"option_analysis": [' + ONE[:-20], C.ANALYSIS_NOT_JSON, C.ANALYSIS_NOT_JSON),
        ('{"option_analysis": []}', C.ANALYSIS_NOT_FOUND, C.ANALYSIS_NOT_FOUND),
        ("nothing", C.ANALYSIS_NOT_FOUND, C.ANALYSIS_NOT_FOUND),
        ("", C.EMPTY_COMPLETION, C.EMPTY_COMPLETION),
    ],
)
def test_parse_option_analysis(spark, text, wrapped, literal):
    for mode, expected in (("wrapped", wrapped), ("literal", literal)):
        ((found,),) = values(
            spark, "t string", [(text,)], C.parse_option_analysis(F.col("t"), mode)
        )
        got = found.reject_reason if found.option_analysis is None else len(found.option_analysis)
        assert got == expected, mode
    if wrapped == 1:
        ((found,),) = values(spark, "t string", [(text,)], C.parse_option_analysis(F.col("t")))
        option = found.option_analysis[0]
        assert option.deduction_steps[0].step == "1" and option.is_correct is True


def test_completion_text(spark):
    ddl = "c array<struct<generated_text:string>>"
    rows = [([("  a\n",), ("b",)],), ([],), (None,), ([(None,)],)]
    found = values(spark, ddl, rows, C.completion_text(F.col("c")))
    assert [f[0] for f in found] == ["a", "", "", ""]


def test_prompts(spark):
    row = (
        "task_type string, context string, question string, options array<string>, answer string, "
        "predicates array<string>, constants array<string>, logical_expressions array<string>"
    )
    data = [
        ("MCQA", "C", "Q", ['say "hi"', "é"], "1", ["p"], [], None),
        ("BQA", "C", "Q", [], "yes", ["p", "q"], ["c"], ["e"]),
        ("NLI", "C", "Q", [], "", [], [], []),
    ]
    df = spark.createDataFrame(data, row)
    cols = {c: F.col(c) for c in df.columns}
    mcqa, bqa, nli = df.select(
        P.option_prompt(cols).alias("p"), P.chat_messages(cols).alias("m")
    ).collect()
    assert nli.p is None and nli.m is None
    assert '"Options": ["say \\"hi\\"", "é"],\n"Answer": "1",\n"Predicates": ["p"],\n"Constants": [],\n"Logical Expressions": []\n}' in mcqa.p
    assert mcqa.p.startswith("system: ") and mcqa.p.endswith("this question.\n")
    assert '"Options": "Q",\n' in bqa.p and '"Predicates": ["p", "q"]' in bqa.p
    assert [m.role for m in mcqa.m] == ["system", "user", "assistant"]
    assert mcqa.m[1].content == 'Context: C\nQuestion: Q\nOptions:\n0. say "hi"\n1. é'
    assert bqa.m[1].content == "Context: C\nQuestion: Q" and bqa.m[2].content == "yes"
    blank, full = values(spark, "c string", [(" \n",), (" text ",)], P.extract_prompt(F.col("c")))
    assert blank == (None,)
    assert full[0].startswith("System: ") and 'work on:\n"text"' in full[0]
    assert full[0].endswith("\n\nAssistant:")
