"""Sends this package to the executors, which may have no copy of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_landmarq_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="landmarq-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._landmarq_shipped = True  # noqa: SLF001
