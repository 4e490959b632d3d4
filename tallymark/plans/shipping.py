"""Sends this package to the executors, so that Python functions find it wherever it runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source, once a Spark application, to the files its workers import from."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    folder = tempfile.mkdtemp(prefix="tallymark-")
    path = os.path.join(folder, "tallymark_source.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    _sent.add(context.applicationId)
