"""Sends this package to the executors, for the functions that run in their Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="rillflow-zip-")).resolve() / "rillflow.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
