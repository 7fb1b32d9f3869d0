"""The package on the executors' path, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors, once in an application.

    Functions that run in Python workers are pickled by name; without this the
    workers would need the package installed or on PYTHONPATH.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_corvane", None):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="corvane-")), "corvane-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.join("corvane", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._corvane = path
