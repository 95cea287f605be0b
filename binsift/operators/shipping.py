"""Giving executors this package: Python code that operators send to tasks refers to it by name."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application, once, unless PYTHONPATH names it (as where it is installed or given by
    --py-files, which adds it there). The archive is made on the driver and fetched from it by executors."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for p in sorted((root / "binsift").rglob("*.py")):
            z.write(p, p.relative_to(root))
    path = Path(tempfile.mkdtemp(prefix="binsift-package-"), "binsift-engine.zip")
    path.write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
