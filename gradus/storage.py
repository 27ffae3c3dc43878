"""Where intermediate tables live.

Lineage is cut by writing a table into the shared folder the session names in
``spark.checkpoint.dir``.  A written table survives the loss of any executor,
keeps column pruning, and is read back as often as needed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Written by this process and not yet released, per application.
_written: dict[str, list[str]] = {}
_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    Under a local master that names none, a folder of this application's own; on a
    cluster the session must name one, as a local folder would not be shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _own_folder:
        _own_folder[application] = tempfile.mkdtemp(prefix="gradus-")
    return _own_folder[application]


def run_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; :func:`release` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/gradus/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = run_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none when it is not there."""
    files, place = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; one that is there is an error."""
    files, place = _file_system(spark, path)
    out = files.create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def move(spark: SparkSession, path: str, target: str) -> None:
    """Rename a file; the target must not be there."""
    files, place = _file_system(spark, path)
    if not files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {path} to {target}")


def make_folder(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def release(spark: SparkSession) -> int:
    """Remove the tables this application has written to the shared folder.

    Call it when the results that were built on them have been written or read:
    frames built before cannot be read again.  Returns how many were removed.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files, place = _file_system(spark, path)
        files.delete(place, True)
    return len(paths)
