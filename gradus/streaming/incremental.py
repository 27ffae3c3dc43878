"""Incremental runs on Structured Streaming: resume where the last run stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.completions import parse_extraction, parse_option_analysis
from gradus.functions.prompts import extract_prompt, option_prompt
from gradus.functions.text import strip
from gradus.operators.filters import has_context
from gradus.operators.generate import Generate, generate_batch
from gradus.operators.joins import anti_join_done
from gradus.operators.scoring import normalise, with_raw_score
from gradus.sources.commits import Commit, commit_batch, new_attempt, read_results
from gradus.streaming.keys import finished_keys, write_keys

KEYS = ("dataname", "id")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a streaming query keeps in its checkpoint for all its runs."""
    lines = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()
    return json.loads(lines[0])["id"]


def finished(
    spark: SparkSession,
    path: str,
    batch_id: int | None = None,
    stream: str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame | None:
    """Keys already done without an error, leaving out the batch being (re)written.

    None when nothing was written yet; a path that cannot be read is an error.  This reads
    all results; a batch asks :func:`gradus.streaming.keys.finished_keys` instead.
    """
    out = read_results(spark, path)
    if out is None:
        return None
    if batch_id is not None:
        rewritten = (F.col("batch") == batch_id) & (F.col("stream") == stream)
        out = out.filter(~rewritten)
    if "error" in out.columns:
        out = out.filter(F.col("error").isNull())
    return out.select(*keys)


def _add(batch: DataFrame, batch_id: int, path: str, stream: str, keys: Sequence[str], work) -> int:
    """Do ``work`` for the keys of a batch that are not finished, and commit its rows and keys.

    Returns how many earlier keys were read to tell.
    """
    spark = batch.sparkSession
    done, read = finished_keys(batch, path, keys, leave_out=(stream, batch_id))
    todo = batch if done is None else anti_join_done(batch, done, keys)
    attempt = new_attempt()
    place = Commit(stream, batch_id, 0, attempt).folder(path)
    work(todo).write.parquet(place)
    made = spark.read.parquet(place)
    good = made.filter(F.col("error").isNull()) if "error" in made.columns else made
    note = write_keys(good.select(*keys).distinct(), keys, path, attempt)
    commit_batch(spark, path, stream, batch_id, attempt, note | {"keys_read": read})
    return read


def extract_step(items: DataFrame, make_generate: Callable[[], Generate]) -> DataFrame:
    """Prompt, generate and parse; rows keep an error or a reject reason."""
    asked = items.filter(has_context()).withColumn("prompt", extract_prompt(F.col("context")))
    made = generate_batch(asked, make_generate).drop("prompt")
    parsed = parse_extraction(strip(F.col("generated_text")))
    return made.withColumn("_p", parsed).select(
        *items.columns, "_p.*", "error"
    )


def option_step(items: DataFrame, make_generate: Callable[[], Generate]) -> DataFrame:
    """Option-analysis prompt, generation and parsing of known task types."""
    row = {c: F.col(c) for c in items.columns}
    asked = items.withColumn("prompt", option_prompt(row)).filter(F.col("prompt").isNotNull())
    made = generate_batch(asked, make_generate).drop("prompt")
    parsed = parse_option_analysis(strip(F.col("generated_text")))
    return made.withColumn("_p", parsed).select(*items.columns, "_p.*", "error")


def incremental_extract(
    items: DataFrame,
    make_generate: Callable[[], Generate],
    path: str,
    checkpoint: str,
    step: Callable[[DataFrame, Callable[[], Generate]], DataFrame] = extract_step,
) -> None:
    """Process what a streaming source of items has new, then stop.

    Finished keys are skipped, so a key that failed is done again when it comes again while
    one that succeeded is never generated twice, whatever checkpoint its run had.  A batch
    reads filters of the keys of earlier ones, and such keys only as may be its own.
    Batches are added by two-phase commit (read them with ``read_results``); a replayed
    one replaces its own output and no other.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        _add(batch, batch_id, path, stream, KEYS, lambda todo: step(todo, make_generate))

    _run(items, handle, checkpoint)


def incremental_score(
    items: DataFrame,
    stats: DataFrame,
    path: str,
    checkpoint: str,
    partitions: int | None = None,
    keys: Sequence[str] = KEYS,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Score new items with frozen statistics and append them.

    The statistics of a data set are never final on a stream, so one row of
    earlier statistics is read first and used for every new item.  Keys scored
    before, under any checkpoint, are skipped.  ``partitions`` deals each batch out
    before scoring; give it when the arriving files are few and cannot be split.
    ``prepare`` makes the fields that are scored from rows that have the keys; a batch is made
    whole whenever it is read, so what is costly or wide belongs there and not in ``items``.
    """
    row = stats.select("mean", "variance").first()
    frozen = items.sparkSession.range(0, 1, 1, 1).select(
        F.lit(row["mean"]).alias("mean"), F.lit(row["variance"]).alias("variance")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        def work(todo: DataFrame) -> DataFrame:
            dealt = todo if partitions is None else todo.repartition(partitions)
            return normalise(with_raw_score(dealt if prepare is None else prepare(dealt)), frozen)

        _add(batch, batch_id, path, stream_id(batch.sparkSession, checkpoint), keys, work)

    _run(items, handle, checkpoint)


def _run(items: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        items.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
