"""Executors need the package: it is zipped once per application and handed to Spark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="weftline-ship-")) / "weftline.zip"  # read by the driver's own file server
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _DONE.add(app)
