"""Accuracy, macro scores and the per-class report.

Each row adds to at most two classes (its label and its prediction), so one
map-side combined aggregation over (group, class) holds everything; no confusion
matrix is collected and no class is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.labels import parse_label


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group and class: hits, support (as label) and predicted count.

    A missing prediction counts for its label's support only.
    """
    hit = F.coalesce((F.col("label") == F.col("predict")).cast("int"), F.lit(0))
    sides = F.array(
        F.struct(F.col("label").alias("cls"), hit.alias("hit"), F.lit(1).alias("is_label")),
        F.struct(F.col("predict").alias("cls"), F.lit(0).alias("hit"), F.lit(0).alias("is_label")),
    )
    return (
        df.select(*group_cols, F.explode(sides).alias("s"))
        .select(*group_cols, "s.*")
        .filter(F.col("cls").isNotNull())
        .groupBy(*group_cols, "cls")
        .agg(
            F.sum("hit").alias("hits"),
            F.sum("is_label").alias("support"),
            F.sum(1 - F.col("is_label")).alias("predicted"),
        )
    )


def per_class(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per class; undefined values are 0."""
    counts = class_counts(df, group_cols)
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(F.lit(2) * F.col("hits"), F.col("predicted") + F.col("support"))
    return counts.select(
        *group_cols,
        "cls",
        "hits",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1_score"),
        "support",
    )


def metrics(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision / recall / F1 over rows where both sides parse.

    ``n_total`` counts all rows of the group and ``n_used`` the parsed ones; a
    group without any usable row gives no row.
    """
    parsed = df.select(
        *group_cols,
        parse_label(F.col("label")).alias("label"),
        parse_label(F.col("predict")).alias("predict"),
    )
    usable = F.col("label").isNotNull() & F.col("predict").isNotNull()
    # One pass: rows without a usable pair go under the null class and only count.
    hit = (F.col("label") == F.col("predict")).cast("int")
    sides = F.when(
        usable,
        F.array(
            F.struct(F.col("label").alias("cls"), hit.alias("hit"), F.lit(1).alias("is_label")),
            F.struct(
                F.col("predict").alias("cls"), F.lit(0).alias("hit"), F.lit(0).alias("is_label")
            ),
        ),
    ).otherwise(
        F.array(
            F.struct(
                F.lit(None).cast("bigint").alias("cls"),
                F.lit(0).alias("hit"),
                F.lit(1).alias("is_label"),
            )
        )
    )
    classes = (
        parsed.select(*group_cols, F.explode(sides).alias("s"))
        .select(*group_cols, "s.*")
        .groupBy(*group_cols, "cls")
        .agg(
            F.sum("hit").alias("hits"),
            F.sum("is_label").alias("support"),
            F.sum(1 - F.col("is_label")).alias("predicted"),
        )
    )
    real = F.col("cls").isNotNull()
    used = F.sum(F.when(real, F.col("support")).otherwise(0))

    def macro(value: Column) -> Column:
        return F.avg(F.when(real, value))

    return (
        classes.groupBy(*group_cols)
        .agg(
            (F.sum(F.when(real, F.col("hits"))) / used).alias("accuracy"),
            macro(_ratio(F.col("hits"), F.col("predicted"))).alias("precision"),
            macro(_ratio(F.col("hits"), F.col("support"))).alias("recall"),
            macro(
                _ratio(F.lit(2) * F.col("hits"), F.col("predicted") + F.col("support"))
            ).alias("f1_score"),
            F.sum("support").alias("n_total"),
            used.alias("n_used"),
        )
        .filter(F.col("n_used") > 0)
    )


def classification_report(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows per class plus accuracy, macro avg and weighted avg, four decimals."""
    rows = per_class(df, group_cols).withColumn("cls", F.col("cls").cast("string"))
    rows = rows.withColumnRenamed("cls", "class")
    support, hits = F.sum("support"), F.sum("hits")

    def averages(label: str, how) -> Column:
        return F.struct(
            F.lit(label).alias("class"),
            how("precision").alias("precision"),
            how("recall").alias("recall"),
            how("f1_score").alias("f1_score"),
            support.alias("support"),
        )

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), support)

    accuracy = _ratio(hits, support)
    nothing = F.lit(None).cast("double")
    summary = (
        rows.groupBy(*group_cols)
        .agg(
            F.array(
                F.struct(
                    F.lit("accuracy").alias("class"),
                    nothing.alias("precision"),
                    nothing.alias("recall"),
                    accuracy.alias("f1_score"),
                    support.alias("support"),
                ),
                averages("macro avg", F.avg),
                averages("weighted avg", weighted),
            ).alias("rows")
        )
        .select(*group_cols, F.explode("rows").alias("r"))
        .select(*group_cols, "r.*")
    )
    out = rows.drop("hits").unionByName(summary)
    return out.select(
        *group_cols,
        "class",
        *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1_score")],
        "support",
    )
