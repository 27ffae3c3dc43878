"""The given tables seen as items, predictions and completions.

All views are row-local and use whole texts: sentences become expressions (some
letters stand for brackets and connectives), lines become options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators.scoring import score_items

# Letters that stand for brackets and connectives in the expressions made from prose.
LETTERS, SYMBOLS = "hgwkbv", "()[]∧¬"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(text: Column) -> Column:
    return F.translate(F.replace(F.lower(text), F.lit("th"), F.lit("->")), LETTERS, SYMBOLS)


def task_type() -> Column:
    return (
        F.when(F.col("lang") == "en", "MCQA")
        .when(F.col("lang") == "es", F.lit(None).cast("string"))
        .when(F.col("lang") == "de", "NLI")
        .otherwise("BQA")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, dealt out by id: each given table is one block, and scoring is costly."""
    return table(spark, sf_dir, "documents").repartition("doc_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(table(spark, sf_dir, "documents"))


def items_of(documents: DataFrame) -> DataFrame:
    """Canonical items from ``documents``."""
    mcqa = F.col("lang") == "en"
    return documents.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("dataname"),
        task_type().alias("task_type"),
        F.upper("lang").alias("reasoning_type"),
        F.col("text").alias("context"),
        F.concat(F.lit("What follows from text "), F.col("doc_id"), F.lit("?")).alias("question"),
        F.split("text", "\n").alias("options"),
        F.when(mcqa, (F.col("n_chars") % 4).cast("string"))
        .otherwise(F.when(F.col("n_chars") % 2 == 0, "yes").otherwise("no"))
        .alias("answer"),
        F.when(F.col("source").isin("src0", "src1"), "test")
        .when(F.col("source") == "src2", "dev")
        .otherwise("train")
        .alias("split"),
    )


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_of(documents(spark, sf_dir))


def extracted_of(documents: DataFrame) -> DataFrame:
    """Items with predicates, constants and expressions."""
    return _with_symbols(documents).drop("sym")


def _with_symbols(documents: DataFrame) -> DataFrame:
    """Extracted items plus ``sym``, the context in symbols."""
    return items_of(documents).withColumn("sym", symbols(F.col("context"))).select(
        "*",
        F.split("context", ",").alias("predicates"),
        F.split("context", " ").alias("constants"),
        F.split("sym", r"\.").alias("logical_expressions"),
    )


def step_expression(sentence: Column) -> Column:
    """A sentence in symbols; the shortest ones stand for failed steps."""
    n = F.length(sentence)
    return (
        F.when(n == 0, "N/A")
        .when(n < 15, "Derivation cannot proceed")
        .when(n < 25, "Derivation cannot proceed.")
        .otherwise(sentence)
    )


def scoring_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring_input_of(documents(spark, sf_dir))


def scoring_input_of(documents: DataFrame) -> DataFrame:
    """Extracted items with the fields of ``option_analysis`` that are scored."""

    def option(line: Column) -> Column:
        return F.struct(
            F.split(line, ",").alias("preconditions"),
            F.transform(
                F.split(line, r"\."), lambda s: F.struct(step_expression(s).alias("expression"))
            ).alias("deduction_steps"),
        )

    lines = F.split("sym", "\n")
    return (
        _with_symbols(documents)
        .withColumn("option_analysis", F.transform(lines, option))
        .drop("sym")
    )


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted items with whole option analyses: one option per line of the text.

    The clauses of a line are its preconditions, its sentences the steps.
    """

    def option(line: Column, i: Column) -> Column:
        return F.struct(
            i.alias("option_index"),
            line.alias("option_text"),
            F.split(line, ",").alias("preconditions"),
            F.concat(F.lit("so "), line).alias("deduction_target"),
            F.transform(
                F.split(line, r"\."),
                lambda s, j: F.struct(
                    (j + 1).cast("string").alias("step"),
                    s.alias("task"),
                    step_expression(s).alias("expression"),
                    F.concat(F.lit("gives "), s).alias("result"),
                ),
            ).alias("deduction_steps"),
            (i == 0).alias("is_correct"),
        )

    return (
        _with_symbols(documents(spark, sf_dir))
        .withColumn("option_analysis", F.transform(F.split("sym", "\n"), option))
        .drop("sym")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataname, id, score_log, score_norm), scored once and kept."""
    return score_items(scoring_input(spark, sf_dir), keep=["dataname", "id"])


def yes_no_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, predict) from ``labels``; no answer for toxic low-quality rows."""
    quality, toxic = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(quality == 1, "yes").otherwise("no").alias("label"),
        F.when((toxic == 1) & (quality == 0), F.lit(None).cast("string"))
        .when(toxic == 0, "yes")
        .otherwise("no")
        .alias("predict"),
    )


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, predict): four classes; vectors of many positive components are missed."""
    label = F.col("label") % 4
    positive = F.size(F.filter("embedding", lambda x: x > 0))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        label.cast("string").alias("label"),
        ((F.col("label") + (positive > F.size("embedding") / 2).cast("int")) % 4)
        .cast("string")
        .alias("predict"),
    )


def scored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the scores of their document."""
    scored = scores(spark, sf_dir).withColumnRenamed("id", "doc_id")
    return yes_no_predictions(spark, sf_dir).join(scored, "doc_id")


def all_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no and four-class predictions with a data set and a model name."""
    binary = yes_no_predictions(spark, sf_dir).select(
        F.lit("labels").alias("dataset"),
        F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("model"),
        "label",
        "predict",
    )
    many = class_predictions(spark, sf_dir).select(
        F.lit("embeddings").alias("dataset"),
        F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("model"),
        "label",
        "predict",
    )
    return binary.unionByName(many)
