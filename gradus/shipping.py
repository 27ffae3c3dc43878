"""Send this library's modules to the executors of a session.

Functions that run in Python workers are pickled by the name of their module, so the
module must be importable there.  Where the library is not installed on the
executors, ``ship`` adds it to the session as a zip file, once per application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, *extra: str) -> None:
    """Make the package importable in the Python workers of this session.

    ``extra`` names further packages or modules beside this one, by their paths.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="gradus-"), "gradus.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for top in (package, *map(os.path.abspath, extra)):
            base = os.path.dirname(top)
            if os.path.isfile(top):
                out.write(top, os.path.relpath(top, base))
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, base))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
