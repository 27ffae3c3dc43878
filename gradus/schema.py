"""Record types of the pipeline and the spaced names used in files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())

ITEM = (
    T.StructType()
    .add("id", T.LongType())
    .add("dataname", _TEXT)
    .add("task_type", _TEXT)
    .add("reasoning_type", _TEXT)
    .add("context", _TEXT)
    .add("question", _TEXT)
    .add("options", _TEXTS)
    .add("answer", _TEXT)
    .add("split", _TEXT)
)

EXTRACTED = (
    T.StructType(list(ITEM.fields))
    .add("predicates", _TEXTS)
    .add("constants", _TEXTS)
    .add("logical_expressions", _TEXTS)
    .add("normalized_complexity_score", T.FloatType())
)

OPTION_ANALYSIS_DDL = (
    "array<struct<option_index:int,option_text:string,preconditions:array<string>,"
    "deduction_target:string,"
    "deduction_steps:array<struct<step:string,task:string,expression:string,result:string>>,"
    "is_correct:boolean>>"
)

PREDICTION = T.StructType().add("label", _TEXT).add("predict", _TEXT)

# Column name here -> key in the JSON files.
FILE_NAMES = {
    "task_type": "task type",
    "reasoning_type": "reasoning type",
    "predicates": "Predicates",
    "constants": "Constants",
    "logical_expressions": "Logical Expressions",
    "normalized_complexity_score": "Normalized Complexity Score",
    "score_log": "ComplexityScore_log",
    "score_norm": "ComplexityScore_norm",
}


def to_file_names(df: DataFrame) -> DataFrame:
    """Rename the columns to the spaced keys used in files."""
    return df.withColumnsRenamed({k: v for k, v in FILE_NAMES.items() if k in df.columns})


def from_file_names(df: DataFrame) -> DataFrame:
    """Rename the spaced keys used in files to column names."""
    return df.withColumnsRenamed({v: k for k, v in FILE_NAMES.items() if v in df.columns})


def file_schema(schema: T.StructType) -> T.StructType:
    """``schema`` with the spaced keys, for reading JSON files."""
    return T.StructType(
        [T.StructField(FILE_NAMES.get(f.name, f.name), f.dataType, True) for f in schema.fields]
    )


def typed_cast(df: DataFrame, schema: T.StructType = EXTRACTED) -> DataFrame:
    """Select exactly the fields of ``schema``, cast; absent fields become null."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )
