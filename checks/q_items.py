"""Normalisation, filters, prompts and parsing of completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.registry import query
from gradus.functions import completions as C
from gradus.functions import prompts as P
from gradus.functions import text as X
from gradus.operators import filters as L
from gradus.operators.generate import generate_batch
from gradus.operators.ordering import assign_ids
from gradus.schema import typed_cast

WS = Q.quote(X.WHITESPACE)
SEP = "'§'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def joined(column):
    """A list of texts as one text, to compare it as a plain value."""
    return F.array_join(column, "§")


# -- projections ------------------------------------------------------------


@query(
    "proj_canonical",
    Q.sql(
        "SELECT id, dataname, coalesce(task_type, '') AS task_type, reasoning_type, context, question, "
        f"array_to_string(CASE WHEN task_type = 'MCQA' OR task_type IS NULL THEN options[1:4] ELSE [] END, {SEP}) AS options, "
        "answer, split FROM items",
        "items",
    ),
)
def proj_canonical(spark, sf_dir):
    items = V.items(spark, sf_dir)
    return items.select(
        "id",
        *[X.text_or_empty(F.col(c)).alias(c) for c in ("dataname", "task_type", "reasoning_type")],
        X.text_or_empty(F.col("context")).alias("context"),
        X.text_or_empty(F.col("question")).alias("question"),
        joined(X.truncate_options(F.col("options"), F.col("task_type"))).alias("options"),
        X.text_or_empty(F.col("answer")).alias("answer"),
        X.text_or_empty(F.col("split")).alias("split"),
    )


@query(
    "opt_truncate4",
    Q.sql(
        f"SELECT id, least(len(o), 4)::BIGINT AS n, array_to_string(o[1:4], {SEP}) AS options "
        "FROM (SELECT id, CASE WHEN task_type IN ('BQA', 'NLI') THEN [] ELSE options END AS o FROM items)",
        "items",
    ),
)
def opt_truncate4(spark, sf_dir):
    kept = X.truncate_options(F.col("options"), F.col("task_type"))
    return V.items(spark, sf_dir).select(
        "id", F.size(kept).cast("bigint").alias("n"), joined(kept).alias("options")
    )


LETTERED_SQL = (
    "list_transform(options, lambda o, i: CASE i % 5 WHEN 0 THEN o ELSE "
    "' ' || 'ABCD'[i % 5] || '. ' || o || ' ' END)"
)


@query(
    "opt_strip_letter",
    Q.sql(
        "SELECT id, array_to_string(list_transform(o, lambda x: CASE WHEN "
        f"{strip('x')}[1:2] IN ('A.', 'B.', 'C.', 'D.') THEN {strip(strip('x') + '[3:]')} "
        f"ELSE {strip('x')} END), {SEP}) AS options FROM (SELECT id, {LETTERED_SQL} AS o FROM items)",
        "items",
    ),
)
def opt_strip_letter(spark, sf_dir):
    def lettered(o, i):
        k = (i + 1) % 5
        letter = F.substring(F.lit("ABCD"), k, 1)
        return F.when(k == 0, o).otherwise(F.concat(F.lit(" "), letter, F.lit(". "), o, F.lit(" ")))

    options = F.transform(F.transform("options", lettered), X.strip_option_letter)
    return V.items(spark, sf_dir).select("id", joined(options).alias("options"))


# The letter of each word of a text, taken from its length; every fifth has none.
WORD_LETTER_SQL = "CASE length(w) % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN 'c' WHEN 3 THEN 'D' ELSE 'e' END"


@query(
    "ans_letter_to_index",
    f"""SELECT doc_id, string_agg(CASE lower(c) WHEN 'a' THEN '0' WHEN 'b' THEN '1' WHEN 'c' THEN '2'
  WHEN 'd' THEN '3' ELSE '' END, ',' ORDER BY i) AS answers
FROM (SELECT doc_id, i, {WORD_LETTER_SQL} AS c FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w,
  generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)) GROUP BY doc_id""",
)
def ans_letter_to_index(spark, sf_dir):
    """Every word of a text stands for an answer letter."""

    def letter(word):
        n = F.length(word) % 5
        return F.when(n == 0, "a").when(n == 1, "B").when(n == 2, "c").when(n == 3, "D").otherwise("e")

    answers = F.transform(F.split("text", " "), lambda w: X.letter_to_index(letter(w)))
    return V.documents(spark, sf_dir).select("doc_id", F.array_join(answers, ",").alias("answers"))


TRUTH_SQL = (
    "CASE WHEN quality = 1 AND toxic = 0 THEN 'True' WHEN quality = 0 AND toxic = 0 THEN 'False' "
    "WHEN quality = 1 THEN 'Uncertain' ELSE 'unknown' END"
)


def truth():
    quality, toxic = F.col("quality"), F.col("toxic")
    return (
        F.when((quality == 1) & (toxic == 0), "True")
        .when((quality == 0) & (toxic == 0), "False")
        .when(quality == 1, "Uncertain")
        .otherwise("unknown")
    )


@query(
    "ans_truth_to_text",
    f"SELECT doc_id, CASE {TRUTH_SQL} WHEN 'True' THEN 'yes' WHEN 'False' THEN 'no' "
    "WHEN 'Uncertain' THEN 'uncertain' ELSE '' END AS answer FROM labels",
)
def ans_truth_to_text(spark, sf_dir):
    return V.table(spark, sf_dir, "labels").select("doc_id", X.truth_to_text(truth()).alias("answer"))


@query(
    "premises_join",
    "SELECT doc_id, array_to_string(string_split(text, chr(10)), ' ') AS context FROM documents",
)
def premises_join(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", X.join_premises(F.split("text", "\n")).alias("context")
    )


# file names made from page addresses, so that every rule is met
PAGE_FILE_SQL = (
    "CASE page_id % 5 WHEN 0 THEN 'Train' WHEN 1 THEN 'dev' WHEN 2 THEN 'val' WHEN 3 THEN 'TEST' "
    "ELSE 'validation' END || '-' || url"
)


def page_file():
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("Train", "dev", "val", "TEST", "validation")]),
        (F.col("page_id") % 5 + 1).cast("int"),
    )
    return F.concat(kind, F.lit("-"), F.col("url"))


@query(
    "split_from_filename",
    f"""SELECT page_id,
  CASE WHEN contains(f, 'train') THEN 'train' WHEN contains(f, 'dev') THEN 'dev'
    WHEN contains(f, 'test') THEN 'test' ELSE '' END AS split_dev,
  CASE WHEN contains(f, 'train') THEN 'train' WHEN contains(f, 'val') THEN 'dev'
    WHEN contains(f, 'test') THEN 'test' ELSE '' END AS split_val,
  CASE WHEN contains(f, 'train') THEN 'train' WHEN contains(f, 'validation') THEN 'test'
    ELSE 'other' END AS split_validation
FROM (SELECT page_id, lower({PAGE_FILE_SQL}) AS f FROM pages)""",
)
def split_from_filename(spark, sf_dir):
    name = page_file()
    rules = X.SPLIT_RULES
    return V.table(spark, sf_dir, "pages").select(
        "page_id",
        X.split_from_name(name, rules["dev"]).alias("split_dev"),
        X.split_from_name(name, rules["val"]).alias("split_val"),
        X.split_from_name(name, rules["validation"], "other").alias("split_validation"),
    )


PAGE_PATH_SQL = (
    "'/data/' || CASE page_id % 4 WHEN 0 THEN 'first_order_logic' WHEN 1 THEN 'nm_logic' "
    "WHEN 2 THEN 'propositional_logic' ELSE 'misc' END || '/' || url || '/nm_logic.json'"
)


@query(
    "reasoning_from_path",
    f"""SELECT page_id, CASE WHEN contains(d, 'first_order_logic') THEN 'FOL'
  WHEN contains(d, 'nm_logic') THEN 'NM' WHEN contains(d, 'propositional_logic') THEN 'PL' ELSE '' END AS reasoning_type
FROM (SELECT page_id, regexp_replace({PAGE_PATH_SQL}, '/[^/]*$', '') AS d FROM pages)""",
)
def reasoning_from_path(spark, sf_dir):
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("first_order_logic", "nm_logic", "propositional_logic", "misc")]),
        (F.col("page_id") % 4 + 1).cast("int"),
    )
    path = F.concat(F.lit("/data/"), kind, F.lit("/"), F.col("url"), F.lit("/nm_logic.json"))
    return V.table(spark, sf_dir, "pages").select(
        "page_id", X.reasoning_from_path(path).alias("reasoning_type")
    )


@query(
    "assign_ids",
    "SELECT row_number() OVER (ORDER BY source, doc_id)::BIGINT AS id, source, doc_id FROM documents",
)
def ids_over_sources(spark, sf_dir):
    """Sequential ids from 1 over all sources in order."""
    documents = V.table(spark, sf_dir, "documents").select("source", "doc_id")
    return assign_ids(documents, order_by=["source", "doc_id"])


@query(
    "assign_ids_per_dataset",
    "SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS id, source, doc_id FROM documents",
)
def ids_per_dataset(spark, sf_dir):
    """Ids restart at 1 in every data set."""
    documents = V.table(spark, sf_dir, "documents").select("source", "doc_id")
    return assign_ids(documents, order_by=["doc_id"], within=["source"])


@query(
    "src_typed_cast",
    Q.sql(
        f"""SELECT id, dataname, task_type, reasoning_type, context, question,
  array_to_string(options, {SEP}) AS options, answer, split, len(predicates)::BIGINT AS n_predicates,
  n_chars::FLOAT::DOUBLE AS legacy_score
FROM extracted JOIN documents ON id = doc_id""",
        "extracted",
    ),
)
def src_typed_cast(spark, sf_dir):
    loose = V.extracted(spark, sf_dir).withColumns(
        {
            "id": F.col("id").cast("string"),
            "normalized_complexity_score": F.length("context").cast("string"),
        }
    )
    return typed_cast(loose).select(
        "id", "dataname", "task_type", "reasoning_type", "context", "question",
        joined(F.col("options")).alias("options"), "answer", "split",
        F.size("predicates").cast("bigint").alias("n_predicates"),
        F.col("normalized_complexity_score").cast("double").alias("legacy_score"),
    )


# -- filters -----------------------------------------------------------------


@query(
    "filter_empty_context",
    f"SELECT conv_id, turn, {strip('text')} = '' AS empty, length(text)::BIGINT AS n FROM conversations",
)
def filter_empty_context(spark, sf_dir):
    """Kept and rejected rows together, with the flag that parts them."""
    turns = V.table(spark, sf_dir, "conversations").withColumnRenamed("text", "context")
    kept, rejected = L.split_empty_context(turns)
    return kept.unionByName(rejected, allowMissingColumns=True).select(
        "conv_id",
        "turn",
        F.col("reject_reason").isNotNull().alias("empty"),
        F.length("context").cast("bigint").alias("n"),
    )


@query(
    "filter_task_type",
    Q.sql("SELECT id, dataname, task_type FROM items WHERE task_type IN ('BQA', 'MCQA')", "items"),
)
def filter_task_type(spark, sf_dir):
    return L.filter_task_type(V.items(spark, sf_dir)).select("id", "dataname", "task_type")


@query(
    "filter_min_id",
    Q.sql("SELECT id, dataname, context FROM items WHERE id >= 128", "items"),
)
def filter_min_id(spark, sf_dir):
    return L.filter_min_id(V.items(spark, sf_dir), 128).select("id", "dataname", "context")


ODD_SCORE_SQL = (
    "CASE WHEN n_chars < 100 THEN NULL WHEN n_chars < 200 THEN 'NaN'::DOUBLE "
    "ELSE (n_chars - 1000) / 3000.0::DOUBLE END"
)


def odd_scores(spark, sf_dir):
    """Scores with nulls, NaN and values on both sides of [0, 1]."""
    n = F.col("n_chars")
    return V.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n < 100, F.lit(None).cast("double"))
        .when(n < 200, F.lit(float("nan")))
        .otherwise((n - 1000) / F.lit(3000.0))
        .alias("score_norm"),
    )


@query(
    "filter_valid_score",
    "SELECT doc_id, round(s, 6) AS score_norm FROM (SELECT doc_id, "
    f"{ODD_SCORE_SQL} AS s FROM documents) WHERE s >= 0 AND s <= 1",
)
def filter_valid_score(spark, sf_dir):
    return L.filter_valid_score(odd_scores(spark, sf_dir)).select(
        "doc_id", F.round("score_norm", 6).alias("score_norm")
    )


@query(
    "filter_score_range",
    Q.sql("SELECT dataname, id FROM scores WHERE score_norm BETWEEN 0.4 AND 1.0", "scores"),
)
def filter_score_range(spark, sf_dir):
    return L.filter_score_range(V.scores(spark, sf_dir), 0.4, 1.0).select("dataname", "id")


@query(
    "filter_split",
    Q.sql("SELECT id, dataname, split, context FROM items WHERE split = 'train'", "items"),
)
def filter_split(spark, sf_dir):
    return L.filter_split(V.items(spark, sf_dir), "train").select("id", "dataname", "split", "context")


@query(
    "exclude_dataset",
    Q.sql("SELECT id, dataname FROM items WHERE dataname <> 'src3'", "items"),
)
def exclude_dataset(spark, sf_dir):
    return L.exclude_dataset(V.items(spark, sf_dir), "src3").select("id", "dataname")


@query(
    "dedup_items",
    Q.sql(
        """SELECT key.d AS dataname, key.i AS id FROM (
  SELECT min({'d': d, 'i': i}) AS key FROM (SELECT dataname || '-' || id % 2 AS d, id // 2 AS i,
    trim(regexp_replace(lower(context), '\\s+', ' ', 'g')) AS c, task_type AS q FROM items) GROUP BY c, q)""",
        "items",
    ),
)
def dedup_items(spark, sf_dir):
    """First item of each normalised context; ids restart in every data set."""
    items = V.items(spark, sf_dir).select(
        F.concat_ws("-", "dataname", F.col("id") % 2).alias("dataname"),
        F.expr("id div 2").alias("id"),
        "context",
        F.coalesce("task_type", F.lit("")).alias("question"),
    )
    return L.dedup_items(items).select("dataname", "id")


# -- prompts -----------------------------------------------------------------


def framed_sql(template, slot: str, before: str, middle: str, after: str) -> str:
    head, tail = template.user.split(slot)
    return f"{Q.quote(before + head)} || {middle} || {Q.quote(tail + after)}"


EXTRACT_SQL = framed_sql(
    P.EXTRACT_TEMPLATE,
    P.CONTEXT_SLOT,
    f"System: {P.EXTRACT_TEMPLATE.system}\n\nUser: ",
    strip("context"),
    "\n\nAssistant:",
)


@query(
    "prompt_extract",
    Q.sql(f"SELECT id, CASE WHEN {strip('context')} <> '' THEN {EXTRACT_SQL} END AS prompt FROM items", "items"),
)
def prompt_extract(spark, sf_dir):
    return V.items(spark, sf_dir).select("id", P.extract_prompt(F.col("context")).alias("prompt"))


def json_list_sql(xs: str) -> str:
    return f"'[' || array_to_string(list_transform({xs}, lambda x: to_json(x)::VARCHAR), ', ') || ']'"


def option_prompt_sql(task: str, options: str) -> str:
    template = P.OPTION_TEMPLATES[task]
    block = " || ".join(
        [
            Q.quote('{\n"Context": "'), "context",
            Q.quote('",\n"Question": "'), "question",
            Q.quote('",\n"Options": '), options,
            Q.quote(',\n"Answer": "'), "answer",
            Q.quote('",\n"Predicates": '), json_list_sql("predicates"),
            Q.quote(',\n"Constants": '), json_list_sql("constants"),
            Q.quote(',\n"Logical Expressions": '), json_list_sql("logical_expressions"),
            Q.quote("\n}"),
        ]
    )
    prompt = framed_sql(template, P.INPUT_SLOT, f"system: {template.system}\nuser: ", block, "\n")
    return Q.sql(f"SELECT id, {prompt} AS prompt FROM extracted WHERE task_type = '{task}'", "extracted")


def option_prompts(spark, sf_dir, task):
    items = V.extracted(spark, sf_dir).filter(F.col("task_type") == task)
    return items.select("id", P.option_prompt({c: F.col(c) for c in items.columns}).alias("prompt"))


@query("prompt_option_mcqa", option_prompt_sql("MCQA", json_list_sql("options")))
def prompt_option_mcqa(spark, sf_dir):
    return option_prompts(spark, sf_dir, "MCQA")


@query("prompt_option_bqa", option_prompt_sql("BQA", "'\"' || question || '\"'"))
def prompt_option_bqa(spark, sf_dir):
    return option_prompts(spark, sf_dir, "BQA")


USER_SQL = (
    "'Context: ' || context || chr(10) || 'Question: ' || question || CASE WHEN task_type = 'MCQA' "
    "THEN chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(options, "
    "lambda o, i: (i - 1) || '. ' || o), chr(10)) ELSE '' END"
)
SYSTEM_SQL = (
    f"CASE task_type WHEN 'BQA' THEN {Q.quote(P.TASK_INSTRUCTION['BQA'])} "
    f"ELSE {Q.quote(P.TASK_INSTRUCTION['MCQA'])} END"
)


def shown_messages(df, last: str):
    m = F.col("messages")
    roles = joined(F.transform(m, lambda x: x["role"]))
    return df.filter(m.isNotNull()).select(
        "id",
        roles.alias("roles"),
        m[0]["content"].alias("system"),
        m[1]["content"].alias("user"),
        (m[2]["content"] if last == "messages" else F.col(last)).alias("answer"),
    )


@query(
    "chat_messages_train",
    Q.sql(
        f"SELECT id, 'system§user§assistant' AS roles, {SYSTEM_SQL} AS system, {USER_SQL} AS \"user\", answer "
        "FROM items WHERE task_type IN ('BQA', 'MCQA')",
        "items",
    ),
)
def chat_messages_train(spark, sf_dir):
    items = V.items(spark, sf_dir)
    messages = P.chat_messages({c: F.col(c) for c in items.columns})
    return shown_messages(items.withColumn("messages", messages), "messages")


@query(
    "chat_messages_infer",
    Q.sql(
        f"SELECT id, 'system§user' AS roles, {SYSTEM_SQL} AS system, {USER_SQL} AS \"user\", answer "
        "FROM items WHERE task_type IN ('BQA', 'MCQA')",
        "items",
    ),
)
def chat_messages_infer(spark, sf_dir):
    items = V.items(spark, sf_dir)
    messages = P.chat_messages({c: F.col(c) for c in items.columns}, with_answer=False)
    return shown_messages(items.withColumn("messages", messages), "answer")


# -- generation and parsing ----------------------------------------------------


def reversing():
    """A stand-in for a model: gives each prompt back, reversed."""

    def generate(prompts):
        return [p[::-1] for p in prompts]

    return generate


@query(
    "generate_batch",
    Q.sql(
        f"SELECT id, reverse({EXTRACT_SQL}) AS generated_text, NULL::VARCHAR AS error FROM items",
        "items",
    ),
)
def generate(spark, sf_dir):
    asked = V.items(spark, sf_dir).select("id", P.extract_prompt(F.col("context")).alias("prompt"))
    return generate_batch(asked, reversing).select("id", "generated_text", "error")


@query(
    "completion_text",
    f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN {strip('text')} WHEN role = 'assistant' "
    f"THEN {strip('chr(9) || text || chr(160)')} ELSE '' END AS completion FROM conversations",
)
def completion_text(spark, sf_dir):
    """User turns give a list, assistant turns a padded list, system turns none."""
    made = F.when(
        F.col("role") == "user", F.array(F.struct(F.col("text").alias("generated_text")))
    ).when(
        F.col("role") == "assistant",
        F.array(
            F.struct(F.concat(F.lit("\t"), "text", F.lit("\xa0")).alias("generated_text")),
            F.struct(F.lit("unused").alias("generated_text")),
        ),
    )
    return V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", C.completion_text(made).alias("completion")
    )


# Completions made from the extracted lists; texts of one source lack a list.
COMPLETION_SQL = (
    "'Here is the output: {\"predicates\": ' || "
    + json_list_sql("predicates")
    + " || ', \"Constants\" : ' || "
    + json_list_sql("constants")
    + " || CASE WHEN dataname = 'src5' THEN '' ELSE ', \"Logical Expressions\": ' || "
    + json_list_sql("logical_expressions")
    + " END || '} Done.'"
)


def completions():
    return F.concat(
        F.lit('Here is the output: {"predicates": '),
        P.json_list(F.col("predicates")),
        F.lit(', "Constants" : '),
        P.json_list(F.col("constants")),
        F.when(F.col("dataname") == "src5", "").otherwise(
            F.concat(F.lit(', "Logical Expressions": '), P.json_list(F.col("logical_expressions")))
        ),
        F.lit("} Done."),
    )


def found_sql(key: str) -> str:
    return f"regexp_extract(t, '(?i)\"?{key}\"?\\s*:\\s*(\\[[^\\]]*\\])', 1)"


def items_sql(raw: str) -> str:
    return f"array_to_string(CASE WHEN complete THEN regexp_extract_all({raw}, '\"([^\"]+)\"', 1) ELSE [] END, {SEP})"


@query(
    "parse_extraction",
    Q.sql(
        "SELECT id, "
        + ", ".join(
            f"CASE WHEN dataname <> 'src5' THEN array_to_string({c}, {SEP}) ELSE '' END AS {c}"
            for c in C.EXTRACTION_KEYS
        )
        + f""", CASE WHEN dataname = 'src5' THEN {COMPLETION_SQL} END AS assistant_content,
  CASE WHEN dataname = 'src5' THEN 'lists not found' END AS reject_reason FROM extracted""",
        "extracted",
    ),
)
def parse_extraction(spark, sf_dir):
    """Whole lists, whatever brackets their items hold."""
    return shown_extraction(V.extracted(spark, sf_dir), "whole")


@query(
    "parse_extraction_literal",
    Q.sql(
        f"""SELECT id, {items_sql('p')} AS predicates, {items_sql('c')} AS constants, {items_sql('e')} AS logical_expressions,
  CASE WHEN NOT complete THEN t END AS assistant_content,
  CASE WHEN NOT complete THEN 'lists not found' END AS reject_reason
FROM (SELECT *, p <> '' AND c <> '' AND e <> '' AS complete FROM (
  SELECT id, t, {found_sql('Predicates')} AS p, {found_sql('Constants')} AS c, {found_sql('Logical Expressions')} AS e
  FROM (SELECT id, {COMPLETION_SQL} AS t FROM extracted)))""",
        "extracted",
    ),
)
def parse_extraction_literal(spark, sf_dir):
    """Lists that end at the first bracket."""
    return shown_extraction(V.extracted(spark, sf_dir), "literal")


def shown_extraction(extracted, mode):
    parsed = extracted.select("id", C.parse_extraction(completions(), mode).alias("p"))
    return parsed.select(
        "id",
        *[joined(F.col(f"p.{c}")).alias(c) for c in C.EXTRACTION_KEYS],
        "p.assistant_content",
        "p.reject_reason",
    )


ANALYSIS_SQL = f"""SELECT id, reasoning_type, (o_index - 1)::BIGINT AS option_index, o.line AS option_text,
  array_to_string(string_split(o.line, ','), {SEP}) AS preconditions, 'so ' || o.line AS deduction_target,
  array_to_string(list_transform(string_split(o.line, '.'), lambda s: {Q.step_expression('s')}), {SEP}) AS expressions,
  o_index = 1 AS is_correct
FROM (SELECT id, reasoning_type, unnest(list_transform(lines, lambda x: {{'line': x}})) AS o,
  generate_subscripts(lines, 1) AS o_index
  FROM (SELECT id, reasoning_type, string_split(sym, chr(10)) AS lines FROM extracted))"""


ANALYSIS_FAULTS = {
    "src5": ('{"option_analysis": [{"option_index": 0, ', "option_analysis is not valid JSON"),
    "src6": ("No analysis of ", "option_analysis not found"),
}


def analysis_completions(spark, sf_dir):
    """Whole analyses in the frames models use, by language; those of two sources are none."""
    whole = F.concat(F.lit('{"option_analysis": '), F.to_json("option_analysis"), F.lit("}"))
    kind = F.col("reasoning_type")
    text = (
        F.when(kind == "FR", F.concat(F.lit("\n"), whole))
        .when(kind == "ES", F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(kind == "DE", whole)
        .otherwise(F.concat(F.lit("Sure: "), whole, F.lit(" I hope this helps.")))
    )
    for source, (start, _) in ANALYSIS_FAULTS.items():
        text = F.when(F.col("dataname") == source, F.concat(F.lit(start), "context")).otherwise(text)
    return V.analysed(spark, sf_dir).select("id", text.alias("text"))


def fault_sql(part: int) -> str:
    cases = " ".join(
        f"WHEN '{source}' THEN {Q.quote(fault[part])}" for source, fault in ANALYSIS_FAULTS.items()
    )
    return f"CASE dataname {cases} END"


@query(
    "parse_option_analysis",
    Q.sql(
        f"""SELECT a.id, option_index, option_text, preconditions, deduction_target, expressions, is_correct,
  NULL::VARCHAR AS assistant_content, NULL::VARCHAR AS reject_reason
FROM ({ANALYSIS_SQL}) a JOIN items i ON a.id = i.id WHERE dataname NOT IN ('src5', 'src6')
UNION ALL
SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, {fault_sql(0)} || context, {fault_sql(1)}
FROM items WHERE dataname IN ('src5', 'src6')""",
        "extracted",
    ),
)
def parse_option_analysis(spark, sf_dir):
    """Written as text, parsed back, one row per option; rejected texts are kept."""
    parsed = analysis_completions(spark, sf_dir).select(
        "id", C.parse_option_analysis(F.col("text")).alias("p")
    )
    options = parsed.select(
        "id", "p.assistant_content", "p.reject_reason", F.explode_outer("p.option_analysis").alias("o")
    )
    return options.select(
        "id",
        F.col("o.option_index").cast("bigint").alias("option_index"),
        "o.option_text",
        joined(F.col("o.preconditions")).alias("preconditions"),
        "o.deduction_target",
        joined(F.transform("o.deduction_steps", lambda s: s["expression"])).alias("expressions"),
        "o.is_correct",
        "assistant_content",
        "reject_reason",
    )


@query(
    "parse_option_analysis_literal",
    Q.sql(
        f"""SELECT id, CASE WHEN dataname NOT IN ('src5', 'src6') THEN 0 END::BIGINT AS n_options,
  {fault_sql(0)} || context AS assistant_content, {fault_sql(1)} AS reject_reason FROM items""",
        "items",
    ),
)
def parse_option_analysis_literal(spark, sf_dir):
    """The key is looked up inside the first object after it, so the list is empty."""
    parsed = analysis_completions(spark, sf_dir).select(
        "id", C.parse_option_analysis(F.col("text"), mode="literal").alias("p")
    )
    return parsed.select(
        "id",
        F.when(F.col("p.option_analysis").isNotNull(), F.size("p.option_analysis"))
        .cast("bigint")
        .alias("n_options"),
        "p.assistant_content",
        "p.reject_reason",
    )
