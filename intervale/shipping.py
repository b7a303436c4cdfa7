"""Make this package importable on every executor."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application, hand the package's code to the driver's file server."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    folder = tempfile.mkdtemp(prefix="ship")  # read by the driver's own file server only
    target = os.path.join(folder, f"{package.name}_code.zip")
    Path(target).write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
