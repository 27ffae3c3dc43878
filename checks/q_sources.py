"""Readers and sinks: the given tables are written in each layout and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.q_items import SEP, joined, strip
from checks.registry import query
from gradus.functions import text as X
from gradus.operators.ordering import assign_ids, range_partitions
from gradus.schema import from_file_names
from gradus.sources import readers as R
from gradus.sources import sinks as K
from gradus.storage import materialise, run_path

ARRAY_CHUNK = 200  # records per JSON array file


def one_line(text):
    return F.regexp_replace(text, r"\s+", " ")


ONE_LINE_SQL = "regexp_replace(text, '\\s+', ' ', 'g')"


def documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


def write_text(df, column, spark, label) -> str:
    path = run_path(spark, label)
    df.select(column.alias("value")).write.text(path)
    return path


def write_one_file_each(df, column, path: str) -> None:
    """One text file per row; a row holds at most one chunk of records."""
    df.select(column.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def shown(items, *more):
    """Items and rejects as plain values; the id is part of the question."""
    return items.select(
        "dataname",
        "task_type",
        "reasoning_type",
        "context",
        "question",
        joined(F.col("options")).alias("options"),
        "answer",
        "split",
        "reject_reason",
        *more,
    )


# -- readers -------------------------------------------------------------------


@query(
    "src_scan_ext",
    f"""SELECT 'json' AS ext, doc_id, {ONE_LINE_SQL} AS line FROM documents
UNION ALL SELECT 'txt', page_id, url FROM pages""",
)
def src_scan_ext(spark, sf_dir):
    """Two kinds of files in one tree; each scan finds its own kind."""
    root = run_path(spark, "tree")
    documents(spark, sf_dir).select("doc_id", one_line("text").alias("line")).write.json(f"{root}/a/b")
    V.table(spark, sf_dir, "pages").select(
        F.concat_ws("\t", "page_id", "url").alias("value")
    ).write.text(f"{root}/c")
    found = R.scan_files(spark, root, ".json").select(
        F.lit("json").alias("ext"),
        F.from_json("value", "doc_id bigint, line string").alias("v"),
    )
    pages = R.scan_files(spark, root, ".txt").select(
        F.lit("txt").alias("ext"),
        F.struct(
            F.split("value", "\t")[0].cast("bigint").alias("doc_id"),
            F.split("value", "\t")[1].alias("line"),
        ).alias("v"),
    )
    return found.unionByName(pages).select("ext", "v.*")


@query(
    "src_text_blocks",
    f"""SELECT 'blocks' AS dataname, 'MCQA' AS task_type, '' AS reasoning_type,
  {strip(ONE_LINE_SQL)} AS context, 'Q ' || doc_id AS question,
  'one' || {SEP} || 'two ' || n_chars || {SEP} || CASE lang WHEN 'es' THEN '' ELSE 'three' END || {SEP} || 'four' AS options,
  CASE lang WHEN 'en' THEN '1' WHEN 'fr' THEN '3' ELSE '' END AS answer, 'train' AS split,
  NULL::VARCHAR AS reject_reason, NULL::VARCHAR AS raw
FROM documents WHERE {strip(ONE_LINE_SQL)} <> ''
UNION ALL SELECT 'blocks', 'MCQA', '', {strip(ONE_LINE_SQL)}, 'Q ' || item_id, 'one', '1', 'train',
  'block ends before its last option', 'b' || chr(10) || {strip(ONE_LINE_SQL)} || chr(10) || 'Q ' || item_id || chr(10) || 'A. one'
FROM benchmark""",
)
def src_text_blocks(spark, sf_dir):
    """Line ends, blank lines and letters differ by language; files of one cut block each.

    English blocks have Windows line ends, French ones a blank line of spaces, German
    ones nothing between them, Spanish ones an empty option and no letter.
    """
    context = X.strip(one_line("text"))

    def block(letter, end, third, after):
        lines = [context, F.concat(F.lit("Q "), "doc_id"), F.lit("A. one")]
        lines += [F.concat(F.lit("B.two "), "n_chars"), F.lit(third), F.lit("D. four")]
        return F.concat(F.lit(letter + end if letter else ""), F.concat_ws(end, *lines), F.lit(after))

    lang = F.col("lang")
    text = (
        F.when(lang == "en", block("b", "\r\n", "three", "\r\n"))
        .when(lang == "fr", block("D", "\n", "three", "\n \t"))
        .when(lang == "de", block("x", "\n", "three", ""))
        .otherwise(block("", "\n", "", "\n"))
    )
    root = run_path(spark, "blocks")
    named = V.documents(spark, sf_dir).filter(context != "")
    named.select(text.alias("value")).write.text(f"{root}/whole")
    cut = F.concat(F.lit("b\n"), context, F.lit("\nQ "), "item_id", F.lit("\nA. one"))
    items = V.table(spark, sf_dir, "benchmark").repartition(spark.sparkContext.defaultParallelism, "item_id")
    write_one_file_each(items, cut, f"{root}/cut")
    return shown(R.read_text_blocks(spark, root, "blocks", default_split="train"), "raw")


@query(
    "src_jsonl_mcqa",
    f"""SELECT 'lines' AS dataname, 'MCQA' AS task_type, '' AS reasoning_type, text AS context, 'Q ' || doc_id AS question,
  CASE lang WHEN 'de' THEN '' ELSE array_to_string(string_split(text, chr(10))[1:4], {SEP}) END AS options,
  n_chars::VARCHAR AS answer, 'dev' AS split, NULL::VARCHAR AS reject_reason, NULL::VARCHAR AS raw,
  CASE lang WHEN 'de' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_options
FROM documents WHERE lang <> 'es'
UNION ALL SELECT 'lines', 'MCQA', '', '', '', '', '', 'dev', 'invalid JSON', '{{"text": ' || {ONE_LINE_SQL}, 0
FROM documents WHERE lang = 'es'""",
)
def src_jsonl_mcqa(spark, sf_dir):
    """German options are no list; Spanish lines do not parse."""
    lang = F.col("lang")
    fields = [
        F.col("text"),
        F.concat(F.lit("Q "), "doc_id").alias("question"),
        F.col("n_chars").alias("answer"),
    ]
    listed = F.to_json(F.struct(*fields, F.split("text", "\n").alias("options")))
    unlisted = F.to_json(F.struct(*fields, F.lit("none").alias("options")))
    line = (
        F.when(lang == "es", F.concat(F.lit('{"text": '), one_line("text")))
        .when(lang == "de", unlisted)
        .otherwise(listed)
    )
    path = write_text(documents(spark, sf_dir), F.concat(line, F.lit("\n")), spark, "lines")
    return shown(
        R.read_jsonl_mcqa(spark, path, "lines", default_split="dev"),
        "raw",
        F.col("n_options").cast("bigint").alias("n_options"),
    )


def chunked(df, entry):
    """JSON arrays of ``ARRAY_CHUNK`` records: those of one id range, whatever their source."""
    return (
        df.groupBy(F.floor(F.col("doc_id") / ARRAY_CHUNK).alias("chunk"))
        .agg(F.collect_list(F.to_json(entry)).alias("entries"))
        .withColumn("array", F.concat(F.lit("[\n"), F.array_join("entries", ",\n"), F.lit("\n]")))
    )


@query(
    "src_json_array_mcqa",
    f"""SELECT 'arrays' AS dataname, 'MCQA' AS task_type, '' AS reasoning_type, text AS context, 'Q ' || doc_id AS question,
  array_to_string(string_split(text, chr(10))[1:4], {SEP}) AS options,
  CASE lang WHEN 'es' THEN '' ELSE (n_chars % 4)::VARCHAR END AS answer, '' AS split, NULL::VARCHAR AS reject_reason
FROM documents""",
)
def src_json_array_mcqa(spark, sf_dir):
    """Spanish entries have no label."""
    entry = F.struct(
        F.col("text").alias("context"),
        F.concat(F.lit("Q "), "doc_id").alias("question"),
        F.split("text", "\n").alias("answers"),
        F.when(F.col("lang") != "es", F.col("n_chars") % 4).alias("label"),
    )
    path = run_path(spark, "arrays")
    write_one_file_each(chunked(documents(spark, sf_dir), entry), F.col("array"), path)
    return shown(R.read_json_array_mcqa(spark, path, "arrays", extension=".txt"))


@query(
    "src_jsonl_premises_bqa",
    """SELECT 'premises' AS dataname, 'BQA' AS task_type, 'FOL' AS reasoning_type,
  array_to_string(string_split(text, chr(10)), ' ') AS context, 'Q ' || doc_id AS question, '' AS options,
  CASE lang WHEN 'en' THEN 'yes' WHEN 'fr' THEN 'no' WHEN 'de' THEN 'uncertain' ELSE '' END AS answer,
  '' AS split, NULL::VARCHAR AS reject_reason
FROM documents""",
)
def src_jsonl_premises_bqa(spark, sf_dir):
    lang = F.col("lang")
    label = F.when(lang == "en", "True").when(lang == "fr", "False").when(lang == "de", "Uncertain")
    path = run_path(spark, "premises")
    documents(spark, sf_dir).select(
        F.split("text", "\n").alias("premises"),
        F.concat(F.lit("Q "), "doc_id").alias("conclusion"),
        label.otherwise("Perhaps").alias("label"),
    ).write.json(path)
    return shown(R.read_jsonl_premises(spark, path, "premises", extension=".json"))


@query(
    "src_nested_qa_bqa",
    """SELECT 'nested' AS dataname, 'BQA' AS task_type, 'NM' AS reasoning_type, text AS context,
  'Q ' || doc_id || ' ' || q AS question, '' AS options, q AS answer, 'train' AS split,
  NULL::VARCHAR AS reject_reason, CASE q WHEN 'yes' THEN 0 ELSE 1 END::BIGINT AS pair
FROM documents, (VALUES ('yes'), ('no')) t(q)""",
)
def src_nested_qa_bqa(spark, sf_dir):
    """Two questions per text in nested records."""
    pairs = F.transform(
        F.array(F.lit("yes"), F.lit("no")),
        lambda a: F.struct(
            F.concat(F.lit("Q "), "doc_id", F.lit(" "), a).alias("question"), a.alias("answer")
        ),
    )
    entry = F.struct(F.col("text").alias("context"), pairs.alias("qa_pairs"))
    root = run_path(spark, "nested")
    nested = chunked(documents(spark, sf_dir), entry)
    document = F.concat(F.lit('{"data_samples": '), "array", F.lit("}"))
    write_one_file_each(nested, document, f"{root}/nm_logic")
    items = R.read_nested_qa(spark, root, "nested", extension=".txt")
    return shown(items, F.col("_pair").cast("bigint").alias("pair"))


@query(
    "src_union_folder",
    f"""SELECT doc_id AS id, text AS context, NULL::VARCHAR AS reject_reason, NULL::VARCHAR AS raw FROM documents
UNION ALL SELECT count(*), source, NULL, NULL FROM documents GROUP BY source
UNION ALL SELECT NULL, NULL, 'invalid JSON', count(*)::VARCHAR FROM documents GROUP BY source
UNION ALL SELECT NULL, NULL, 'invalid JSON', '{{"id": ' || source FROM documents GROUP BY source""",
)
def src_union_folder(spark, sf_dir):
    """Arrays of documents, one object, one bare number and one broken file per source."""
    root = run_path(spark, "union")
    entry = F.struct(F.col("doc_id").alias("id"), F.col("text").alias("context"))
    write_one_file_each(chunked(documents(spark, sf_dir), entry), F.col("array"), f"{root}/arrays")
    sizes = documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("id"))
    single = F.to_json(F.struct("id", F.col("source").alias("context")))
    write_one_file_each(sizes, single, f"{root}/objects")
    write_one_file_each(sizes, F.col("id").cast("string"), f"{root}/scalars")
    write_one_file_each(sizes, F.concat(F.lit('{"id": '), "source"), f"{root}/broken")
    rows = R.read_union_folder(spark, root, "id bigint, context string", extension=".txt")
    return rows.select("id", "context", "reject_reason", X.strip(F.col("raw")).alias("raw"))


@query(
    "src_jsonl_lenient",
    "SELECT doc_id, text, n_chars FROM documents WHERE lang <> 'es'",
)
def src_jsonl_lenient(spark, sf_dir):
    """Lines of Spanish texts are broken and disappear."""
    line = F.when(F.col("lang") == "es", F.concat(F.lit('{"doc_id": "'), one_line("text"))).otherwise(
        F.to_json(F.struct("doc_id", "text", "n_chars"))
    )
    path = write_text(documents(spark, sf_dir), line, spark, "lenient")
    schema = "doc_id bigint, text string, n_chars bigint"
    return R.read_jsonl_lenient(spark, path, schema, extension=".txt").select(
        "doc_id", "text", "n_chars"
    )


def write_predictions(spark, sf_dir) -> dict[str, str]:
    """A folder per data set with a folder per model."""
    root = run_path(spark, "predictions")
    made = materialise(V.all_predictions(spark, sf_dir), "predictions-table")
    K.write_predictions(made, root)
    return {d: f"{root}/{d}" for d in ("labels", "embeddings")}


@query(
    "src_predictions_tree",
    Q.sql("SELECT dataset, model, label, predict FROM all_predictions", "all_predictions"),
)
def src_predictions_tree(spark, sf_dir):
    found = R.read_predictions_tree(spark, write_predictions(spark, sf_dir))
    return found.select("dataset", "model", "label", "predict")


@query(
    "src_predictions_folders",
    Q.sql(
        "SELECT CASE dataset WHEN 'embeddings' THEN 0 ELSE 2 END::BIGINT AS source_rank, label, predict "
        "FROM all_predictions",
        "all_predictions",
    ),
)
def src_predictions_folders(spark, sf_dir):
    """The second folder does not exist and is skipped."""
    roots = write_predictions(spark, sf_dir)
    folders = [roots["embeddings"], roots["labels"] + "-missing", roots["labels"]]
    return R.read_predictions_folders(spark, folders).select(
        F.col("source_rank").cast("bigint").alias("source_rank"), "label", "predict"
    )


# -- sinks -----------------------------------------------------------------------


@query(
    "sink_dataset",
    Q.sql(
        f"""SELECT id, dataname, task_type, reasoning_type, context, question, array_to_string(options, {SEP}) AS options,
  answer, split FROM items""",
        "items",
    ),
)
def sink_dataset(spark, sf_dir):
    """Partitioned JSON lines with the spaced keys, read back."""
    path = run_path(spark, "dataset")
    K.write_dataset(V.items(spark, sf_dir), path)
    read = spark.read.schema(
        "id bigint, `task type` string, `reasoning type` string, context string, question string, "
        "options array<string>, answer string, dataname string, split string"
    ).json(path)
    return from_file_names(read).select(
        "id", "dataname", "task_type", "reasoning_type", "context", "question",
        joined(F.col("options")).alias("options"), "answer", "split",
    )


@query(
    "sink_append_results",
    Q.sql(
        "SELECT id, context, CASE WHEN task_type = 'MCQA' THEN 1 ELSE 2 END::BIGINT AS batch FROM items",
        "items",
    ),
)
def sink_append_results(spark, sf_dir):
    """Two batches, the second written twice as after a retry."""
    path = run_path(spark, "append")
    items = V.items(spark, sf_dir).select("id", "context", "task_type")
    mcqa = F.coalesce(F.col("task_type") == "MCQA", F.lit(False))
    K.append_results(items.filter(mcqa), path, 1)
    for _ in range(2):
        K.append_results(items.filter(~mcqa), path, 2)
    return K.read_results(spark, path).select("id", "context", F.col("batch").cast("bigint").alias("batch"))


@query(
    "assign_ids_scan_order",
    """SELECT row_number() OVER (ORDER BY doc_id)::BIGINT AS id, 'Q ' || doc_id AS question, text AS context
FROM documents""",
)
def assign_ids_scan_order(spark, sf_dir):
    """Written as several files in the order of their names; ids follow the scan.

    There are at least four files, and as many as the scan of the table has parts, so that no
    task's share grows with the table.
    """
    path = run_path(spark, "scan")
    docs = documents(spark, sf_dir)
    files = max(4, range_partitions(docs), docs.rdd.getNumPartitions())
    docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").select(
        "text", F.concat(F.lit("Q "), "doc_id").alias("question")
    ).write.json(path)
    items = R.read_jsonl_mcqa(spark, path, "scan", extension=".json")
    return assign_ids(R.accepted(items)).select("id", "question", "context")
