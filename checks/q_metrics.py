"""Label normalisation and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.registry import query
from gradus.functions import labels as G
from gradus.operators import metrics as M
from gradus.sources import sinks as K
from gradus.storage import run_path

# Turns of a conversation stand for generated texts; even turns are yes/no tasks.
TURN_TASK_SQL = "CASE WHEN turn % 2 = 0 THEN 'BQA' ELSE 'MCQA' END"
TURN_TEXT_SQL = "'assistant' || chr(10) || chr(10) || text || ' ' || conv_id || '/' || turn"


def turns(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 2 == 0, "BQA").otherwise("MCQA").alias("task_type"),
        F.concat(
            F.lit("assistant\n\n"), "text", F.lit(" "), "conv_id", F.lit("/"), "turn"
        ).alias("text"),
    )


@query(
    "normalize_prediction",
    f"""SELECT conv_id, turn, CASE task_type WHEN 'BQA' THEN
    CASE WHEN contains(lower(t), 'yes') THEN 'yes' WHEN contains(lower(t), 'no') THEN 'no' END
  ELSE CASE WHEN contains(t, '0') THEN '0' WHEN contains(t, '1') THEN '1'
    WHEN contains(t, '2') THEN '2' WHEN contains(t, '3') THEN '3' END END AS predict
FROM (SELECT conv_id, turn, {TURN_TASK_SQL} AS task_type,
  replace({TURN_TEXT_SQL}, 'assistant' || chr(10) || chr(10), '') AS t FROM conversations)""",
)
def normalize_prediction(spark, sf_dir):
    return turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        G.normalize_prediction(F.col("text"), F.col("task_type")).alias("predict"),
    )


@query(
    "lower_labels",
    "SELECT conv_id, turn AS predict, lower(role || ' ' || text) AS label FROM conversations",
)
def lower_labels(spark, sf_dir):
    """Labels are texts, predictions numbers that stay as they are."""
    turns = V.table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("predict"), F.concat_ws(" ", "role", "text").alias("label")
    )
    return G.lower_labels(turns)


PARSED = """CASE WHEN regexp_full_match(lower(trim({c})), '[0-9]+') THEN TRY_CAST(trim({c}) AS BIGINT)
  WHEN lower(trim({c})) = 'yes' THEN 1 WHEN lower(trim({c})) = 'no' THEN 0 END"""
MIXED_SQL = "CASE WHEN turn % 3 = 0 THEN ' ' || turn || ' ' WHEN turn % 3 = 1 THEN 'Yes' WHEN role = 'user' THEN 'NO' ELSE text END"


@query(
    "parse_label",
    f"SELECT conv_id, turn, ({PARSED.format(c='m')})::BIGINT AS label "
    f"FROM (SELECT conv_id, turn, {MIXED_SQL} AS m FROM conversations)",
)
def parse_label(spark, sf_dir):
    turn = F.col("turn")
    mixed = (
        F.when(turn % 3 == 0, F.concat(F.lit(" "), turn.cast("string"), F.lit(" ")))
        .when(turn % 3 == 1, "Yes")
        .when(F.col("role") == "user", "NO")
        .otherwise(F.col("text"))
    )
    return V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", G.parse_label(mixed).alias("label")
    )


def metrics_sql(source: str, by: str) -> str:
    """Accuracy and macro scores from per-class counts."""
    return f"""SELECT {by}, round(sum(hits) / sum(support), 6) AS accuracy,
  round(avg(CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END), 6) AS "precision",
  round(avg(CASE WHEN support > 0 THEN hits / support ELSE 0 END), 6) AS recall,
  round(avg(2 * hits / (predicted + support)), 6) AS f1_score,
  any_value(n_total)::BIGINT AS n_total, sum(support)::BIGINT AS n_used
FROM (
  SELECT {by}, cls, sum(hit) AS hits, sum(is_label) AS support, sum(1 - is_label) AS predicted
  FROM (
    SELECT {by}, l AS cls, (l = p)::INT AS hit, 1 AS is_label FROM used
    UNION ALL SELECT {by}, p, 0, 0 FROM used) GROUP BY {by}, cls)
JOIN (SELECT {by}, count(*) AS n_total FROM {source} GROUP BY {by}) USING ({by})
GROUP BY {by}"""


def used_cte(source: str) -> str:
    return f"""used AS (SELECT * FROM (SELECT *, {PARSED.format(c='label')} AS l,
  {PARSED.format(c='predict')} AS p FROM {source}) WHERE l IS NOT NULL AND p IS NOT NULL)"""


def shown(df, *by):
    return df.select(
        *by,
        *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")],
        "n_total",
        "n_used",
    )


BY_MODEL = metrics_sql("all_predictions", "dataset, model")
BY_DATASET = metrics_sql("all_predictions", "dataset")


@query("accuracy_macro_prf", Q.sql(BY_DATASET, "all_predictions", extra=used_cte("all_predictions")))
def accuracy_macro_prf(spark, sf_dir):
    return shown(M.metrics(V.all_predictions(spark, sf_dir), ["dataset"]), "dataset")


@query("metrics_by_model", Q.sql(BY_MODEL, "all_predictions", extra=used_cte("all_predictions")))
def metrics_by_model(spark, sf_dir):
    by = ["dataset", "model"]
    return shown(M.metrics(V.all_predictions(spark, sf_dir), by), *by)


@query(
    "sink_metrics_table",
    Q.sql(
        f'SELECT dataset, model, accuracy, "precision", recall, f1_score FROM ({BY_MODEL})',
        "all_predictions",
        extra=used_cte("all_predictions"),
    ),
)
def sink_metrics_table(spark, sf_dir):
    """Written as one CSV table per data set and read back."""
    path = run_path(spark, "metrics")
    K.write_metrics(M.metrics(V.all_predictions(spark, sf_dir), ["dataset", "model"]), path)
    schema = "model string, accuracy double, precision double, recall double, f1_score double"
    read = spark.read.option("header", "true").schema(f"{schema}, dataset string").csv(path)
    return shown_table(read)


def shown_table(df):
    names = ("accuracy", "precision", "recall", "f1_score")
    return df.select("dataset", "model", *[F.round(c, 6).alias(c) for c in names])


@query(
    "classification_report",
    Q.sql(
        """SELECT dataset, cls AS class, round(p, 4) AS "precision", round(r, 4) AS recall,
  round(f, 4) AS f1_score, support::BIGINT AS support FROM per_class
UNION ALL
SELECT dataset, 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 4), sum(support)::BIGINT
FROM per_class GROUP BY dataset
UNION ALL
SELECT dataset, 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(support)::BIGINT
FROM per_class GROUP BY dataset
UNION ALL
SELECT dataset, 'weighted avg', round(sum(p * support) / sum(support), 4),
  round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4),
  sum(support)::BIGINT FROM per_class GROUP BY dataset""",
        "all_predictions",
        extra="""sides AS (
  SELECT dataset, label AS cls, coalesce(label = predict, false)::INT AS hit, 1 AS is_label
  FROM all_predictions
  UNION ALL SELECT dataset, predict, 0, 0 FROM all_predictions WHERE predict IS NOT NULL),
counts AS (
  SELECT dataset, cls, sum(hit) AS hits, sum(is_label) AS support, sum(1 - is_label) AS predicted
  FROM sides GROUP BY ALL),
per_class AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p,
    CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r,
    2 * hits / (predicted + support) AS f FROM counts)""",
    ),
)
def classification_report(spark, sf_dir):
    return M.classification_report(V.all_predictions(spark, sf_dir), ["dataset"])
