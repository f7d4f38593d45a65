"""The session the library runs in, and its code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int = 8, **more: str) -> SparkSession:
    """A session with the settings the library expects; ``more`` are settings with _ for the dots."""
    b = SparkSession.builder.appName("veilspan").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    for k, v in more.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once a session: their Python workers import it by name."""
    sc = spark.sparkContext
    if not getattr(sc, "_veilspan_shipped", False):
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="veilspan-code-"), "veilspan.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        sc._veilspan_shipped = True
    return spark
