"""Readers for the source layouts.

Every reader returns items in the canonical columns plus ``reject_reason`` and
``raw`` for records that do not fit, and the scan-order columns ``_file``,
``_block`` and ``_row``.  Use :func:`accepted` and :func:`rejected` to part them
and ``assign_ids`` for sequential ids.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.functions import text as X
from gradus.operators.ordering import SCAN_ORDER
from gradus.schema import PREDICTION
from gradus.sources import blocks as B
from gradus.sources import documents as D
from gradus.storage import exists

ITEM_COLUMNS = [
    "id", "dataname", "task_type", "reasoning_type", "context", "question", "options", "answer",
    "split",
]
_CORRUPT = "_corrupt_record"
log = logging.getLogger(__name__)


def glob_for(extension: str) -> str:
    """Glob for an extension in any letter case."""
    letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    return f"*{letters}"


def _reader(spark: SparkSession, extension: str, recursive: bool = True):
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", glob_for(extension))


def _scan_order() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def scan_files(
    spark: SparkSession, path: str, extension: str, recursive: bool = True
) -> DataFrame:
    """Lines of all files with the extension, in scan order."""
    return _reader(spark, extension, recursive).text(path).select("value", *_scan_order())


def _json(
    spark: SparkSession, path: str, ddl: str | T.StructType, extension: str, multi_line: bool,
    recursive: bool = True,
) -> DataFrame:
    if isinstance(ddl, str):
        schema = f"{ddl}, {_CORRUPT} string"
    else:
        schema = T.StructType([*ddl.fields, T.StructField(_CORRUPT, T.StringType())])
    return (
        _reader(spark, extension, recursive)
        .option("multiLine", str(multi_line).lower())
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .schema(schema)
        .json(path)
    )


def _one_split_bytes(spark: SparkSession) -> int:
    """Files up to this size are never split: Spark's splits are as large as a file costs to open, at least."""

    def size(name: str) -> int:
        number, unit = re.fullmatch(r"(\d+) *([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
        return int(number) << 10 * " kmgtp".index(unit or " ")

    return min(size("spark.sql.files.openCostInBytes"), size("spark.sql.files.maxPartitionBytes"))


def _json_records(
    spark: SparkSession, path: str, ddl: str | T.StructType, extension: str, inside_key: str | None = None
) -> DataFrame:
    """Records of JSON documents that are read in splits, parsed one by one.

    A record that does not parse has its text in the corrupt column, and so has every
    split of a file that is not whole.
    """
    scan = _reader(spark, extension).option("lineSep", D.SEPARATOR).text(path)
    size = F.col("_metadata.file_size")

    def lines(chosen: Column) -> DataFrame:
        return scan.where(chosen).select("value", *_scan_order(), size.alias("_size"))

    one_split = size <= _one_split_bytes(spark)
    records, broken = D.json_records(lines(~one_split), inside_key, lines(one_split))
    fields = (T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl).fields
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"}
    entry = F.from_json("text", schema, options)
    parsed = records.withColumn("_e", F.when(F.startswith("text", F.lit("{")), entry)).select(
        *[F.col(f"_e.`{f.name}`").alias(f.name) for f in fields],
        F.when(F.col("_e").isNull(), F.col("text")).otherwise(F.col(f"_e.{_CORRUPT}")).alias(_CORRUPT),
        *SCAN_ORDER,
    )
    return parsed.unionByName(broken.withColumnRenamed("raw", _CORRUPT), allowMissingColumns=True)


def _json_entries(spark: SparkSession, path: str, ddl: str, extension: str) -> DataFrame:
    """Entries of JSON arrays written one to a line, read in splits."""
    entry = F.regexp_replace(F.trim("value"), r",$", "")
    parsed = F.from_json(entry, f"{ddl}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT})
    return (
        _reader(spark, extension)
        .text(path)
        .where(~F.trim("value").isin("[", "]", "", "[]"))
        .select(parsed.alias("_entry"), *_scan_order())
        .select("_entry.*", *SCAN_ORDER)
    )


def canonical(
    dataname: str,
    task_type: str,
    reasoning_type: Column | str = "",
    context: Column | None = None,
    question: Column | None = None,
    options: Column | None = None,
    answer: Column | None = None,
    split: Column | str = "",
    max_options: int | None = X.MAX_OPTIONS,
) -> list[Column]:
    """The nine canonical fields; missing texts are empty, ids are null.

    Options beyond ``max_options`` are cut; None keeps all.
    """
    task = F.lit(task_type)

    def text(value: Column | str | None) -> Column:
        value = F.lit(value or "") if not isinstance(value, Column) else value
        return X.text_or_empty(value)

    none = F.array().cast("array<string>")
    return [
        F.lit(None).cast("bigint").alias("id"),
        F.lit(dataname).alias("dataname"),
        task.alias("task_type"),
        text(reasoning_type).alias("reasoning_type"),
        text(context).alias("context"),
        text(question).alias("question"),
        X.truncate_options(none if options is None else options, task, max_options).alias("options"),
        text(answer).alias("answer"),
        text(split).alias("split"),
    ]


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull()).select(
        "dataname", "reject_reason", "raw", *SCAN_ORDER
    )


def _n_options(options: Column) -> Column:
    return F.coalesce(F.size(options), F.lit(0)).alias("n_options")


def _name_of_file() -> Column:
    return F.regexp_extract("_file", "([^/]*)$", 1)


def _split(rules: Sequence[tuple[str, str]], default: str) -> Column:
    return X.split_from_name(F.col("_metadata.file_name"), rules, default)


def read_text_blocks(
    spark: SparkSession,
    path: str,
    dataname: str,
    reasoning_type: str = "",
    split_rules: Sequence[tuple[str, str]] = X.SPLIT_RULES["dev"],
    default_split: str = "",
    extension: str = ".txt",
) -> DataFrame:
    """Multiple-choice blocks: optional answer letter, context, question, 4 options.

    Lines may end in any way; blank lines between blocks are optional, and a blank
    line inside a block is an empty question or option.  A file may be cut into any
    splits.  A block that the file ends in is rejected with its lines.
    """
    blocks = B.blocks_of_lines(scan_files(spark, path, extension))
    line = lambda i: X.strip(F.get("lines", F.lit(i)))
    options = F.transform(F.slice("lines", 3, 4), lambda o: X.strip_option_letter(X.strip(o)))
    cut = F.col("raw").isNotNull()
    return blocks.select(
        *canonical(
            dataname,
            "MCQA",
            reasoning_type,
            context=line(0),
            question=line(1),
            options=options,
            answer=X.letter_to_index(X.strip(F.col("letter"))),
            split=X.split_from_name(_name_of_file(), split_rules, default_split),
        ),
        F.when(cut, "block ends before its last option").alias("reject_reason"),
        "raw",
        *SCAN_ORDER,
    )


def _is_bad(anchor: str) -> Column:
    """True for a record that did not parse.

    Spark refuses a JSON scan that needs no field but the corrupt record, as in
    counting the rejects, so the test mentions the field ``anchor`` as well.
    """
    corrupt = F.isnotnull(F.col(_CORRUPT)).cast("int")
    return corrupt * 2 + F.isnull(F.col(f"`{anchor}`")).cast("int") >= 2


def _bad_json(anchor: str) -> list[Column]:
    return [
        F.when(_is_bad(anchor), "invalid JSON").alias("reject_reason"),
        F.col(_CORRUPT).alias("raw"),
    ]


def read_jsonl_mcqa(
    spark: SparkSession,
    path: str,
    dataname: str,
    task_type: str = "MCQA",
    reasoning_type: str = "",
    split_rules: Sequence[tuple[str, str]] = X.SPLIT_RULES["dev"],
    default_split: str = "",
    extension: str = ".txt",
    max_options: int | None = X.MAX_OPTIONS,
) -> DataFrame:
    """One JSON object per line with ``text, question, options, answer``.

    ``options`` that are not a list give an empty list.  Options beyond
    ``max_options`` are cut (None keeps all); ``n_options`` counts those that were
    there.
    """
    raw = _json(
        spark, path, "text string, question string, options string, answer string", extension, False
    )
    return raw.select(
        *canonical(
            dataname,
            task_type,
            reasoning_type,
            context=F.col("text"),
            question=F.col("question"),
            options=F.from_json("options", "array<string>"),
            answer=F.col("answer"),
            split=_split(split_rules, default_split),
            max_options=max_options,
        ),
        _n_options(F.from_json("options", "array<string>")),
        *_bad_json("question"),
        *_scan_order(),
    )


def read_json_array_mcqa(
    spark: SparkSession,
    path: str,
    dataname: str,
    reasoning_type: str = "",
    split_rules: Sequence[tuple[str, str]] = X.SPLIT_RULES["val"],
    default_split: str = "",
    extension: str = ".json",
    max_options: int | None = X.MAX_OPTIONS,
    lines: bool = False,
) -> DataFrame:
    """A JSON array per file with ``context, question, answers, label``.

    Files are read in splits, however their entries are laid out; where each entry stands
    on a line of its own, ``lines=True`` saves looking for their bounds.  An entry that does
    not parse is rejected, and a file that is not whole with all its text.  Options
    beyond ``max_options`` are cut (None keeps all); ``n_options`` counts those that
    were there.
    """
    ddl = "context string, question string, answers array<string>, label string"
    if lines:
        raw = _json_entries(spark, path, ddl, extension)
    else:
        raw = _json_records(spark, path, ddl, extension)
    return raw.select(
        *canonical(
            dataname,
            "MCQA",
            reasoning_type,
            context=F.col("context"),
            question=F.col("question"),
            options=F.col("answers"),
            answer=F.col("label"),
            split=X.split_from_name(_name_of_file(), split_rules, default_split),
            max_options=max_options,
        ),
        _n_options(F.col("answers")),
        *_bad_json("question"),
        *SCAN_ORDER,
    )


def read_jsonl_premises(
    spark: SparkSession,
    path: str,
    dataname: str,
    reasoning_type: str = "FOL",
    split_rules: Sequence[tuple[str, str]] = X.SPLIT_RULES["validation"],
    default_split: str = "",
    extension: str = ".jsonl",
) -> DataFrame:
    """Yes/no items per line with ``premises, conclusion, label``."""
    raw = _json(
        spark, path, "premises array<string>, conclusion string, label string", extension, False
    )
    return raw.select(
        *canonical(
            dataname,
            "BQA",
            reasoning_type,
            context=X.join_premises(F.col("premises")),
            question=F.col("conclusion"),
            answer=X.truth_to_text(F.col("label")),
            split=_split(split_rules, default_split),
        ),
        *_bad_json("conclusion"),
        *_scan_order(),
    )


def read_nested_qa(
    spark: SparkSession,
    path: str,
    dataname: str,
    reasoning_rules: Sequence[tuple[str, str]] = X.REASONING_RULES,
    split: str = "train",
    extension: str = ".json",
) -> DataFrame:
    """``data_samples[].qa_pairs[]``: one yes/no item per question.

    Files are read in splits, a sample being a record of its own place.  The scan order
    gains ``_sample`` (0) and ``_pair``.
    """
    ddl = "context string, qa_pairs array<struct<question:string,answer:string>>"
    raw = _json_records(spark, path, ddl, extension, "data_samples").withColumn(
        "_reasoning", X.reasoning_from_path(F.col("_file"), reasoning_rules)
    )
    bad = [F.col("reject_reason"), F.col("raw")]
    samples = raw.select(
        *_bad_json("context"),
        "_reasoning",
        *SCAN_ORDER,
        F.lit(0).alias("_sample"),
        F.struct("context", "qa_pairs").alias("_s"),
    )
    pairs = samples.select(
        *bad,
        "_reasoning",
        *SCAN_ORDER,
        "_sample",
        F.col("_s.context").alias("_context"),
        F.posexplode_outer("_s.qa_pairs").alias("_pair", "_qa"),
    ).filter(F.col("_qa").isNotNull() | F.col("reject_reason").isNotNull())
    return pairs.select(
        *canonical(
            dataname,
            "BQA",
            F.col("_reasoning"),
            context=F.col("_context"),
            question=F.col("_qa.question"),
            answer=F.col("_qa.answer"),
            split=split,
        ),
        *bad,
        *SCAN_ORDER,
        "_sample",
        "_pair",
    )


def read_union_folder(
    spark: SparkSession, path: str, schema: str | T.StructType, extension: str = ".json"
) -> DataFrame:
    """Folder of JSON files: arrays give their elements, objects one row each.

    Files are read in splits.  Scalars and malformed files keep their text in ``raw`` with a
    reason, a row for each split; an entry that does not parse is rejected alone.
    """
    raw = _json_records(spark, path, schema, extension)
    fields = [c for c in raw.columns if c not in (_CORRUPT, *SCAN_ORDER)]
    return raw.select(*[F.col(f"`{c}`") for c in fields], *_bad_json(fields[0]), *SCAN_ORDER)


def read_jsonl_lenient(
    spark: SparkSession, path: str, schema: str | T.StructType, extension: str = ".jsonl"
) -> DataFrame:
    """Flat folder of JSON lines; lines that do not parse are dropped."""
    raw = _json(spark, path, schema, extension, False, recursive=False)
    fields = [c for c in raw.columns if c != _CORRUPT]
    return raw.filter(~_is_bad(fields[0])).select(
        *[F.col(f"`{c}`") for c in fields], *_scan_order()
    )


# Fixed value: name of a prediction file.
PREDICTIONS_FILE = "generated_predictions.jsonl"
#: That file, or the files of the folder of that name which Spark writes.
PREDICTIONS_GLOB = "{generated_predictions.jsonl,part-*.json}"


def _predictions(spark: SparkSession, path: str, file_glob: str) -> DataFrame:
    """All lines; those that do not parse have ``reject_reason`` and ``raw``."""
    schema = T.StructType([*PREDICTION.fields, T.StructField(_CORRUPT, T.StringType())])
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", file_glob)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .schema(schema)
        .json(path)
    )
    return raw.select("label", "predict", *_bad_json("label"), *_scan_order())


def rejected_predictions(df: DataFrame) -> DataFrame:
    """Lines that did not parse, of what a prediction reader returned with ``keep_bad``."""
    return df.filter(F.col("reject_reason").isNotNull())


def _good(df: DataFrame, keep_bad: bool) -> DataFrame:
    return df if keep_bad else df.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw")


def model_of_path(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.regexp_extract(path, rf"([^/]+)(?:/{PREDICTIONS_FILE})?/[^/]+$", 1)


def read_predictions_tree(
    spark: SparkSession,
    roots: dict[str, str],
    file_glob: str = PREDICTIONS_GLOB,
    keep_bad: bool = False,
) -> DataFrame:
    """All prediction files below each data set's root, with ``dataset`` and ``model``.

    Lines that do not parse are left out; ``keep_bad`` keeps them with a reason.
    """
    trees = [
        _good(_predictions(spark, root, file_glob), keep_bad)
        .withColumn("dataset", F.lit(dataset))
        .withColumn("model", model_of_path(F.col("_file")))
        for dataset, root in roots.items()
    ]
    whole = trees[0]
    for tree in trees[1:]:
        whole = whole.unionByName(tree)
    return whole


def read_predictions_folders(
    spark: SparkSession,
    folders: Sequence[str],
    file_glob: str = PREDICTIONS_GLOB,
    keep_bad: bool = False,
    report: Callable[[str], None] = log.warning,
    on_error: str = "raise",
) -> DataFrame:
    """Predictions of an ordered list of folders; missing ones are reported and skipped.

    Order by ``source_rank`` and the scan order to keep the list order.  A folder
    that is there but cannot be read is an error; with ``on_error="skip"`` every folder is
    read once beforehand, and one that cannot be read is reported and skipped too.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be raise or skip")
    whole = None
    for rank, folder in enumerate(folders):
        if not exists(spark, folder):
            report(f"skipped, not there: {folder}")
            continue
        if on_error == "skip":
            try:
                _predictions(spark, folder, file_glob).write.format("noop").mode("overwrite").save()
            except Exception as failure:  # whatever the file system or the format raises
                report(f"skipped, cannot be read: {folder}: {type(failure).__name__}")
                continue
        part = _good(_predictions(spark, folder, file_glob), keep_bad).withColumn(
            "source_rank", F.lit(rank)
        )
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        raise ValueError("none of the folders is there")
    return whole


FORMATS: dict[str, Callable[..., DataFrame]] = {
    "text_blocks": read_text_blocks,
    "jsonl_mcqa": read_jsonl_mcqa,
    "json_array_mcqa": read_json_array_mcqa,
    "jsonl_premises": read_jsonl_premises,
    "nested_qa": read_nested_qa,
}


def read_items(spark: SparkSession, path: str, fmt: str, dataname: str, **options) -> DataFrame:
    """Items of one source layout with ``reject_reason`` and ``raw``; see :data:`FORMATS`.

    ``options`` are those of the layout's own reader.
    """
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {sorted(FORMATS)}")
    return FORMATS[fmt](spark, path, dataname, **options)
