"""Incremental runs over the given tables as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.q_items import SEP, joined, strip
from checks.registry import query
from gradus.operators.scoring import score_stats, with_raw_score
from gradus.sources.commits import read_results
from gradus.storage import run_path
from gradus.streaming.incremental import incremental_extract, incremental_score


def stream(spark, sf_dir, name):
    """A given table as a stream: all its files have arrived.

    The path is a glob, which streams take for one file as well as for a folder of files.
    """
    schema = V.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def as_items(turns):
    return turns.select(
        F.concat_ws("-", F.lit("conv"), "conv_id").alias("dataname"),
        F.col("turn").alias("id"),
        F.col("text").alias("context"),
    )


def echo_lists(predicate):
    """A stand-in for a model: lists made from the length of the prompt."""

    def make():
        def generate(prompts):
            return [
                f'{{"Predicates": ["{predicate}"], "Constants": ["a", "b"], '
                f'"Logical Expressions": ["P({len(p)})"]}}'
                for p in prompts
            ]

        return generate

    return make


def prompt_length_sql() -> str:
    from checks.q_items import EXTRACT_SQL

    return f"length({EXTRACT_SQL})"


@query(
    "incremental_extract",
    f"""SELECT 'conv-' || conv_id AS dataname, turn AS id, CASE role WHEN 'user' THEN 'P' ELSE 'Q' END AS predicates, 'a' || {SEP} || 'b' AS constants,
  'P(' || {prompt_length_sql()} || ')' AS logical_expressions, NULL::VARCHAR AS reject_reason, NULL::VARCHAR AS error
FROM (SELECT *, text AS context FROM conversations) WHERE {strip('context')} <> ''""",
)
def extract_twice(spark, sf_dir):
    """Users' turns first; then all turns, under a new checkpoint and with another model.

    The second run must leave what the first one made and add the rest.
    """
    path, checkpoints = run_path(spark, "extracted"), run_path(spark, "extract-checkpoints")
    turns = stream(spark, sf_dir, "conversations")
    users = turns.filter(F.col("role") == "user")
    incremental_extract(as_items(users), echo_lists("P"), path, f"{checkpoints}/users")
    incremental_extract(as_items(turns), echo_lists("Q"), path, f"{checkpoints}/all")
    return read_results(spark, path).select(
        "dataname",
        "id",
        joined(F.col("predicates")).alias("predicates"),
        joined(F.col("constants")).alias("constants"),
        joined(F.col("logical_expressions")).alias("logical_expressions"),
        "reject_reason",
        "error",
    )


@query(
    "incremental_score",
    Q.sql(
        "SELECT dataname, id, round(score_log, 6) AS score_log, round(score_norm, 6) AS score_norm FROM scores",
        "scores",
    ),
)
def score_stream(spark, sf_dir):
    """Documents arrive as streams and are scored with statistics frozen before.

    English ones come first; the second stream has all and scores the others.
    """
    path, checkpoints = run_path(spark, "scored"), run_path(spark, "score-checkpoints")
    stats = score_stats(with_raw_score(V.scoring_input(spark, sf_dir)))
    keys = [F.col("source").alias("dataname"), F.col("doc_id").alias("id")]
    arriving = stream(spark, sf_dir, "documents").select("*", *keys)
    cores = spark.sparkContext.defaultParallelism
    for name, docs in (("en", arriving.filter(F.col("lang") == "en")), ("all", arriving)):
        incremental_score(
            docs, stats, path, f"{checkpoints}/{name}", cores, prepare=V.scoring_input_of
        )
    return read_results(spark, path).select(
        "dataname",
        "id",
        F.round("score_log", 6).alias("score_log"),
        F.round("score_norm", 6).alias("score_norm"),
    )
