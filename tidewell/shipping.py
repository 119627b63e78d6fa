"""Sending this package to the executors.

Workers import it by name; they need not start in its folder or have it on
their path.
"""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_tidewell_sent", False):
        top = Path(__file__).resolve().parent
        d = tempfile.mkdtemp()  # Spark serves the file from here as long as the driver runs
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        name = f"{d}/{top.name}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(name)
        sys.path[:] = [p for p in sys.path if not p.endswith(f"/{top.name}.zip")]  # the driver has the package itself
        sc._tidewell_sent = True
    return spark
