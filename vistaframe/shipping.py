"""Makes this package importable in Python workers wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors, once for an application."""
    app = spark.sparkContext.applicationId
    if app not in _done:
        root = Path(__file__).resolve().parent
        copy = Path(tempfile.mkdtemp(prefix="spark-code-"))
        shutil.copytree(root, copy / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(copy / root.name), "zip", copy / "src"))
        _done.add(app)
    return spark
