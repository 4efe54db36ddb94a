"""Makes this package importable in the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors once for each Spark context."""
    sc = spark.sparkContext
    if sc not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="folioscope-"), "folioscope.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc)
    return spark
