"""The package as a zip for Python workers that can't import it from a path of their own."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of the session's context, once."""
    sc = spark.sparkContext
    if getattr(sc, "_siftline_sent", False) or os.environ.get("SIFTLINE_INSTALLED"):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp()) / "siftline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "siftline").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._siftline_sent = True
