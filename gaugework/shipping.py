"""Sending this package to the executors, for functions that run in Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's files, once per application. Does nothing where it already comes from an archive."""
    if spark.sparkContext.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):
        archive = os.path.join(tempfile.mkdtemp(), "gaugework_source.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in sorted(os.walk(top)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("gaugework", os.path.relpath(path, top)))
        spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)
