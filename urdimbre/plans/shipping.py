"""Sending the library's code to executors that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the files of the session's application, once."""
    if spark.sparkContext.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(spark.sparkContext.applicationId)


def shipped(run: Callable) -> Callable:
    @wraps(run)
    def with_code(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return run(spark, folder)

    return with_code
