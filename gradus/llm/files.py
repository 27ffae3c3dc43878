"""Files of a shared folder, read and written by tasks as byte ranges.

Spark has no reader or writer for flat binary files of any layout, so tasks open
them with Arrow's file systems, which know local folders mounted everywhere, HDFS
and the usual object stores.  A task writes under a name of its own attempt; only
names that a committed table lists are ever read, so files of failed or repeated
attempts are never seen.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream for a new file; the folder is made."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def size(uri: str) -> int:
    system, path = open_fs(uri)
    return system.get_file_info(path).size


def read_range(uri: str, offset: int, length: int) -> bytes:
    """``length`` bytes from ``offset`` on; fewer at the end of the file."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as file:
        return file.read_at(length, offset)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name no other task or attempt has."""
    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"
