"""Getting this package to Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let the session's Python workers import this package, wherever they run; once an application.

    Spark hands the archive from the driver to the executors itself.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if context.applicationId not in _SHIPPED and root.is_dir():
        folder = tempfile.mkdtemp(prefix="typeweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / "typeweave.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for f in sorted(root.rglob("*.py")):
                archive.write(f, f.relative_to(root.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
