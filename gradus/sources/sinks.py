"""Writers for the results of each step."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.bins import interval_text
from gradus.schema import to_file_names
from gradus.sources.commits import append_results, read_results
from gradus.storage import exists, list_names, make_folder, move, remove

__all__ = [
    "append_results", "bin_stats_lines", "histogram_line", "histogram_lines", "metrics_table",
    "read_results", "report_lines", "write_dataset", "write_lines", "write_metrics", "write_predictions",
]

# Fixed value: name of a prediction file.
PREDICTIONS_FILE = "generated_predictions.jsonl"

# Fixed values
HISTOGRAM_HEADER = "分数区间及对应的数据个数："
COUNT_LINE = "区间 %s: 总数 = %d, 正确数 = %d, 错误数 = %d"
RATE_LINE = "区间 %s: 错误率 = %.2f%%"
METRIC_COLUMNS = ["model", "accuracy", "precision", "recall", "f1_score"]


def write_dataset(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("dataname", "split"),
    fmt: str = "json",
    mode: str = "errorifexists",
) -> None:
    """Items as JSON lines (spaced keys) or Parquet, one folder per data set and split.

    The rebalance lets Spark cut a large data set into many files and gather the
    small ones, so the file count follows the data volume.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if fmt == "json":
        df = to_file_names(df)
    df.write.mode(mode).partitionBy(*partition_by).format(fmt).save(path)


def histogram_line() -> Column:
    return F.concat(
        interval_text(F.col("lower"), F.col("upper"), F.col("closed_right")),
        F.lit(": "),
        F.col("count").cast("string"),
    )


def histogram_lines(histogram: DataFrame) -> DataFrame:
    """Header and one text line per bin, as (line_no, value)."""
    header = histogram.sparkSession.range(0, 1, 1, 1).select(
        F.lit(0).alias("line_no"), F.lit(HISTOGRAM_HEADER).alias("value")
    )
    body = histogram.select(
        (F.col("bin") + 1).cast("int").alias("line_no"), histogram_line().alias("value")
    )
    return header.unionByName(body)


def bin_stats_lines(stats: DataFrame) -> DataFrame:
    """Count and rate lines per bin, as (bin_index, counts, rate)."""
    return stats.select(
        "bin_index",
        F.format_string(COUNT_LINE, "bin", "total", "correct", "errors").alias("counts"),
        F.format_string(RATE_LINE, F.col("bin"), F.col("error_rate") * 100).alias("rate"),
    )


def write_lines(lines: DataFrame, order: str, value: str, path: str) -> None:
    """A report of a few lines as one text file, in order."""
    lines.select(order, value).coalesce(1).sortWithinPartitions(order).select(value).write.text(path)


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Metrics in the fixed column order, with the data set first."""
    return metrics.select("dataset", *METRIC_COLUMNS)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per data set holding the metrics of its models.

    Each data set is gathered in one file; the metrics before that are not.
    """
    table = metrics_table(metrics).repartition("dataset")
    writer = table.write.partitionBy("dataset").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def write_predictions(
    df: DataFrame, root: str, dataset: str = "dataset", model: str = "model", mode: str = "append"
) -> None:
    """Label and prediction of each row as JSON lines, a folder per data set and model.

    The layout is ``root/<data set>/<model>/generated_predictions.jsonl/``; the
    prediction readers find it by their defaults.
    """
    if mode not in ("append", "overwrite", "errorifexists"):
        raise ValueError(f"unknown mode {mode}")
    spark, root = df.sparkSession, root.rstrip("/")
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    named = {c: F.coalesce(F.col(own).cast("string"), F.lit("None")) for c, own in (("_d", dataset), ("_m", model))}
    df.select("label", "predict", *[v.alias(k) for k, v in named.items()]).write.partitionBy("_d", "_m").json(staged)
    # One pass over the rows; what is left is to move folders, one per model.
    for data in list_names(spark, staged):
        for name in list_names(spark, f"{staged}/{data}") if "=" in data else ():
            target = "/".join(unquote(part.split("=", 1)[1]) for part in (data, name))
            _place(spark, f"{staged}/{data}/{name}", f"{root}/{target}/{PREDICTIONS_FILE}", mode)
    remove(spark, staged)


def _place(spark: SparkSession, folder: str, target: str, mode: str) -> None:
    """Move a written folder to its place, or its files beside those that are there."""
    if exists(spark, target):
        if mode == "errorifexists":
            raise FileExistsError(target)
        if mode == "append":
            for name in list_names(spark, folder):
                move(spark, f"{folder}/{name}", f"{target}/{name}")
            return
        remove(spark, target)
    make_folder(spark, target.rsplit("/", 1)[0])
    move(spark, folder, target)


def report_lines(report: DataFrame) -> DataFrame:
    """Text lines of a classification report, as (line_no, value); classes first."""
    columns = ["precision", "recall", "f1_score"]
    order = F.when(F.col("row") == "accuracy", 1).when(F.col("row") == "macro avg", 2).when(
        F.col("row") == "weighted avg", 3
    ).otherwise(0)
    numbers = [F.coalesce(F.format_string("%10.2f", c), F.lit(" " * 10)) for c in columns]
    value = F.concat(F.lpad("row", 12, " "), *numbers, F.format_string("%10d", "support"))
    # One row per class of a report.
    return report.select(F.struct(order.alias("o"), F.col("row").alias("r")).alias("line_no"), value.alias("value"))
