"""Sends the package to the executors, for clusters on which it is not installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once; Python functions that run on executors import from it."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    if root.suffix == ".zip" or not root.is_dir():  # already run from a shipped archive
        return
    path = Path(tempfile.mkdtemp(prefix="graphspark-")) / "graphspark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
