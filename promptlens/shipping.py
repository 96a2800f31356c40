"""Makes the package importable on executors, wherever the driver found it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _DONE:
        _DONE.add(app)
        root = Path(__file__).resolve().parent
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/promptlens", "zip", root.parent, root.name))
