"""Getting this package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> SparkSession:
    """The same session; its workers can import this package, wherever they run. Once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_evoked_shipped", False):
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="evoked-")) / "evoked.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(target))
        sc._evoked_shipped = True
    return spark
