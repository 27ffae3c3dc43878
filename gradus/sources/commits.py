"""Results of batches, added by two-phase commit.

A batch is first written as a whole into a folder of its own attempt, which no reader looks
at.  Then a small commit file that names the attempt is renamed into place, and from then on
readers see this attempt instead of an earlier one of the same batch.  A run that dies
anywhere leaves the old rows or the new ones, never neither and never both.

Layout below the path: ``stream=<s>/batch=<b>/attempt=<a>/`` holds rows,
``_commits/`` one file per commit, named so that the last commit of a batch is known
from the names alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gradus.storage import exists, list_names, move, remove, write_small

COMMITS = "_commits"


@dataclass(frozen=True)
class Commit:
    """The attempt that counts for one batch of one stream."""

    stream: str
    batch: int
    version: int
    attempt: str

    def name(self) -> str:
        return json.dumps([self.stream, self.batch, self.version, self.attempt]).encode().hex() + ".commit"

    def folder(self, path: str) -> str:
        return f"{path.rstrip('/')}/stream={self.stream}/batch={self.batch}/attempt={self.attempt}"


def _parsed(name: str) -> Commit:
    return Commit(*json.loads(bytes.fromhex(name.removesuffix(".commit"))))


def commits(spark: SparkSession, path: str) -> dict[tuple[str, int], Commit]:
    """The last commit of each batch; as many as there are batches."""
    found: dict[tuple[str, int], Commit] = {}
    for name in list_names(spark, f"{path.rstrip('/')}/{COMMITS}"):
        if name.endswith(".commit"):
            commit = _parsed(name)
            key = (commit.stream, commit.batch)
            if key not in found or found[key].version < commit.version:
                found[key] = commit
    return found


def new_attempt() -> str:
    return uuid.uuid4().hex


def commit_batch(
    spark: SparkSession, path: str, stream: str, batch: int, attempt: str, note: dict | None = None
) -> Commit:
    """Make ``attempt`` the one that counts and remove the rows of the one before.

    The commit file is written beside and renamed, so it is there whole or not at all.
    Removing comes last; if it is cut short, readers still pass over what is left.
    """
    root = path.rstrip("/")
    before = commits(spark, path).get((stream, batch))
    made = Commit(stream, batch, before.version + 1 if before else 1, attempt)
    waiting = f"{root}/{COMMITS}/.{attempt}"
    write_small(spark, waiting, json.dumps(note or {}))
    move(spark, waiting, f"{root}/{COMMITS}/{made.name()}")
    if before is not None:
        remove(spark, before.folder(root))
    return made


def notes(spark: SparkSession, path: str) -> dict[str, dict]:
    """What was noted with each commit, by attempt; one job however many there are."""
    if not commits(spark, path):
        return {}
    reader = spark.read.option("pathGlobFilter", "*.commit").option("wholetext", "true")
    rows = reader.text(f"{path.rstrip('/')}/{COMMITS}").select("value", "_metadata.file_name").collect()
    return {_parsed(r.file_name).attempt: json.loads(r.value) for r in rows}


def append_results(
    df: DataFrame, path: str, batch_id: int, stream: str = "default", note: dict | None = None
) -> Commit:
    """Add one batch of one stream; only the same batch written again is replaced.

    Batch numbers restart with every checkpoint, so ``stream`` must tell the checkpoints
    that write to ``path`` apart.  One writer at a time may write a batch of a stream.
    """
    attempt = new_attempt()
    spark = df.sparkSession
    df.write.parquet(Commit(stream, batch_id, 0, attempt).folder(path))
    return commit_batch(spark, path, stream, batch_id, attempt, note)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all committed batches, with ``stream`` and ``batch``; None before the first commit.

    A path that is there without commits, or whose rows cannot be read, is an error.
    """
    found = commits(spark, path)
    if not found:
        if exists(spark, path):
            raise ValueError(f"{path} holds no committed results")
        return None
    folders = [c.folder(path) for c in found.values()]
    reader = spark.read.option("basePath", path).option("mergeSchema", "true")
    return reader.parquet(*folders).drop("attempt")
