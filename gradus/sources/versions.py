"""Tables of records repaired file by file.

A version of a table is a list of Parquet files.  A repair finds the files that hold a record to
replace, rewrites only these, and takes all the others over by name, so its cost is that of the
files it touches.  The list is written beside and renamed into place: readers see the version
before or the one after.  One writer at a time; readers of an older version keep their files until
:func:`vacuum`.

Layout below the path: ``data/<attempt>/*.parquet``, and ``_versions/<number>.json`` with the
files of a version.  A list holds a name per file, as many as Spark's own scan lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators.joins import first_targets
from gradus.storage import list_names, materialise, move, remove, write_small

VERSIONS = "_versions"
_SUFFIX = ".json"
#: Repaired places (two row numbers each, some 40 MB in all) that are broadcast; beyond, records are shuffled to them.
BROADCAST_PLACES = 1_000_000


@dataclass(frozen=True)
class Merge:
    """What a repair did: the version it made, the files it rewrote and those it left."""

    version: int
    rewritten: int
    kept: int


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, in order."""
    names = list_names(spark, f"{path.rstrip('/')}/{VERSIONS}")
    return sorted(int(n.removesuffix(_SUFFIX)) for n in names if n[0] != "." and n.endswith(_SUFFIX))


def files_of(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """Files of a version, or of the last one, below ``data``."""
    found = versions(spark, path)
    if not found or (version is not None and version not in found):
        raise ValueError(f"{path} has no version {'' if version is None else version}".rstrip())
    name = f"{path.rstrip('/')}/{VERSIONS}/{found[-1] if version is None else version}{_SUFFIX}"
    return json.loads(spark.read.option("wholetext", "true").text(name).first()[0])


def _write(df: DataFrame, path: str) -> list[str]:
    attempt = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/data/{attempt}"
    df.write.parquet(folder)
    names = list_names(df.sparkSession, folder)
    return sorted(f"{attempt}/{n}" for n in names if n.endswith(".parquet"))


def _commit(spark: SparkSession, path: str, version: int, files: list[str]) -> None:
    folder = f"{path.rstrip('/')}/{VERSIONS}"
    waiting = f"{folder}/.{uuid.uuid4().hex}"
    write_small(spark, waiting, json.dumps(files))
    move(spark, waiting, f"{folder}/{version}{_SUFFIX}")


def create_table(df: DataFrame, path: str) -> int:
    """Write version 1 of a table; a path that has versions is an error."""
    if versions(df.sparkSession, path):
        raise ValueError(f"{path} is a table already")
    _commit(df.sparkSession, path, 1, _write(df, path))
    return 1


def _read(spark: SparkSession, path: str, files: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path.rstrip('/')}/data/{f}" for f in files])


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of a version, or of the last one."""
    return _read(spark, path, files_of(spark, path, version))


def merge_table(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str] = ("dataname", "id"),
    order: str = "ordinal",
) -> Merge:
    """Replace records of the last version as ``upsert`` does, in the files that hold them.

    The last source record of a key replaces the first target record of that key; null keys
    match nothing, unmatched source records are ignored, extra source columns too.  ``order``
    is a unique row number in both.  A repair that matches nothing makes no version.

    What is to be replaced is found on keys alone.  A replaced record takes only its keys and its
    place from the target, so no text of the target is joined with one of the source; new records
    go to files of their own beside what is left of the touched ones.
    """
    keys = list(keys)
    before = files_of(spark, path)
    target = _read(spark, path, before)
    latest = source.dropna(subset=keys).groupBy(*keys).agg(F.max(order).alias("_last"))
    latest = materialise(latest, "repairs")
    # Keys and places only: the scan reads no other column.
    places = target.select(*keys, order, F.col("_metadata.file_name").alias("_name"))
    first = first_targets(places, latest, keys, order, ["_name"])
    found = materialise(first.join(latest, keys), "places")
    # At most one name per file of the table.
    names = {r._name for r in found.select("_name").distinct().collect()}
    touched = [f for f in before if f.rsplit("/", 1)[1] in names]
    kept = [f for f in before if f.rsplit("/", 1)[1] not in names]
    last = versions(spark, path)[-1]
    if not touched:
        return Merge(last, 0, len(kept))
    # Row numbers are unique, so they stand for the keys.
    pairs = found.select(F.col(order).alias("_place"), "_last")
    if found.count() <= BROADCAST_PLACES:
        pairs = F.broadcast(pairs)
    left = _read(spark, path, touched).join(pairs, F.col(order) == F.col("_place"), "left_anti")
    fields = [c for c in target.columns if c not in (order, *keys)]
    new = (
        source.select(*keys, F.col(order).alias("_last"), *fields)
        .join(pairs, "_last")
        .withColumnRenamed("_place", order)
    )
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema]
    made = _write(left.select(*target.columns).unionByName(new.select(*typed)), path)
    _commit(spark, path, last + 1, kept + made)
    return Merge(last + 1, len(touched), len(kept))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the last ``keep`` versions and the files only they name; how many files went.

    The lists go first, so a run cut short leaves files that no version names; files of an attempt that died
    before its commit are such files too, and go.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    root = path.rstrip("/")
    found = versions(spark, path)
    needed = {f for v in found[-keep:] for f in files_of(spark, path, v)}
    for version in found[:-keep]:
        remove(spark, f"{root}/{VERSIONS}/{version}{_SUFFIX}")
    removed = 0
    for attempt in list_names(spark, f"{root}/data"):
        for name in list_names(spark, f"{root}/data/{attempt}"):
            if name.endswith(".parquet") and f"{attempt}/{name}" not in needed:
                remove(spark, f"{root}/data/{attempt}/{name}")
                removed += 1
    return removed
