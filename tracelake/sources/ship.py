"""Sending this package to the executors, whose Python may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tracelake


def ship(spark: SparkSession) -> None:
    """Once a context: the package as a zip file that the driver serves to all executors."""
    context = spark.sparkContext
    if getattr(context, "_tracelake_shipped", False):
        return
    root = Path(tracelake.__file__).parent
    name = os.path.join(tempfile.mkdtemp(prefix="tracelake-"), "tracelake.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(name)
    context._tracelake_shipped = True
