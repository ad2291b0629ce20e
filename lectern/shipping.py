"""Python code for the executors: the package as a zip, sent once an application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with the package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
