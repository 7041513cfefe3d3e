"""Make the package importable on executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def importable() -> bool:
    """True if workers find the package by themselves: by PYTHONPATH or by the working folder."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return any(Path(p).resolve() == _ROOT for p in [*paths, os.getcwd()])


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once a session, where they need it."""
    app = spark.sparkContext.applicationId
    if app in _shipped or importable():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quarterloom-"), "quarterloom-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "quarterloom").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
