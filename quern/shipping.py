"""Makes the package importable where tasks run, if it isn't already."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


@functools.cache
def _add(sc: SparkContext) -> None:
    at = Path(tempfile.mkdtemp()) / "quern.zip"  # read by this driver only, which serves it to all executors
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "quern").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(at))


def ship(spark: SparkSession) -> None:
    """Send the package along unless workers find it by their folder or PYTHONPATH. Once a session."""
    known = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    if not any((p / "quern" / "shipping.py").exists() for p in known):
        _add(spark.sparkContext)
