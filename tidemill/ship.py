"""Makes this package importable for Python workers that were started without it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application.

    Nothing is sent if PYTHONPATH, which workers inherit, names the repository.
    """
    root = Path(__file__).resolve().parent
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if any(p and Path(p).resolve() == root.parent for p in paths):
        return
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="tidemill-src-")) / "tidemill_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
