"""Row filters of the pipeline.  All are plain predicates that push down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.bins import is_valid_score
from gradus.functions.text import strip
from gradus.storage import materialise

# Fixed values
KNOWN_TASKS = ("BQA", "MCQA")


def has_context(context: str = "context") -> Column:
    return strip(F.coalesce(F.col(context), F.lit(""))) != ""


def split_empty_context(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a context, and the rejected rest with a reason."""
    rejected = df.filter(~has_context()).withColumn("reject_reason", F.lit("empty context"))
    return df.filter(has_context()), rejected


def filter_task_type(df: DataFrame, known: Sequence[str] = KNOWN_TASKS) -> DataFrame:
    return df.filter(F.col("task_type").isin(*known))


def filter_min_id(df: DataFrame, start_id: int) -> DataFrame:
    return df.filter(F.col("id") >= start_id)


def filter_valid_score(df: DataFrame, score: str = "score_norm") -> DataFrame:
    return df.filter(is_valid_score(F.col(score)))


def filter_score_range(
    df: DataFrame, lo: float, hi: float, score: str = "score_norm"
) -> DataFrame:
    return df.filter(F.col(score).between(lo, hi))


def filter_split(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def exclude_dataset(df: DataFrame, *datanames: str) -> DataFrame:
    return df.filter(~F.col("dataname").isin(*datanames))


def content_key(*columns: str) -> Column:
    """md5 of the lower-cased, whitespace-collapsed text of the columns."""
    parts = [
        strip(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
        for c in columns
    ]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def dedup_items(
    df: DataFrame,
    key: Column | None = None,
    row_key: Sequence[str] = ("dataname", "id"),
) -> DataFrame:
    """First row (by ``row_key``) of each group of equal content.

    ``row_key`` must tell all rows apart: ids restart in every data set, so the
    default has both.  Rows that share it stay or go together; null parts count as
    values.  Building the frame reads the content once and writes hashes and keys.
    Copies are found by a map-side combined ``min`` over (hash, row key), so a
    content repeated in a third of all rows costs one row per task in the shuffle;
    the records are then anti-joined with the keys of the later copies, by broadcast
    when that table is small on disk.
    """
    key = content_key("context", "question") if key is None else key
    slim = materialise(df.select(key.alias("_key"), F.struct(*row_key).alias("_row")), "content")
    first = slim.groupBy("_key").agg(F.min("_row").alias("_first"))
    copies = slim.join(first.select("_first"), F.col("_row") == F.col("_first"), "left_anti")
    later = materialise(copies.select("_row").distinct(), "copies")
    return df.join(later, F.struct(*row_key) == F.col("_row"), "left_anti")
