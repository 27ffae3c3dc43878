"""Labels and predictions as comparable values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gradus.functions.text import strip

# Fixed values
ASSISTANT_PREFIX = "assistant\n\n"
ANSWER_DIGITS = ("0", "1", "2", "3")


def normalize_prediction(text: Column, task_type: Column) -> Column:
    """Answer contained in a generated text, null when there is none."""
    text = F.replace(text, F.lit(ASSISTANT_PREFIX), F.lit(""))
    low = F.lower(text)
    yes_no = F.when(low.contains("yes"), "yes").when(low.contains("no"), "no")
    digit = F.lit(None).cast("string")
    for d in reversed(ANSWER_DIGITS):
        digit = F.when(text.contains(d), d).otherwise(digit)
    return F.when(task_type == "BQA", yes_no).when(task_type == "MCQA", digit)


def lower_labels(df: DataFrame, columns: Sequence[str] = ("label", "predict")) -> DataFrame:
    """Lower-case the label columns that hold text; others stay as they are."""
    texts = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.lower(F.col(f"`{c}`")) for c in texts})


def parse_label(label: Column) -> Column:
    """Class number: digits as integer, yes/no as 1/0, otherwise null."""
    text = F.lower(strip(label))
    return (
        F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
        .when(text == "yes", F.lit(1).cast("bigint"))
        .when(text == "no", F.lit(0).cast("bigint"))
    )


def error_flag(label: Column, predict: Column) -> Column:
    """True when they differ; a missing side counts as an error."""
    return F.coalesce(label != predict, F.lit(True))
