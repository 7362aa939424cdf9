"""Puts this package on the executors of a session whose Python workers can't import it yet."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python path, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace_sources.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(ROOT.rglob("*.py")):
            z.write(source, source.relative_to(ROOT.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
