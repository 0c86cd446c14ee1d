"""Make the package importable on the workers, wherever the driver was started."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship_package(context: SparkContext) -> None:
    """Send the package's sources to the executors of a context, once."""
    if context.applicationId in _sent:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(PACKAGE.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-code-"), "plumbline.zip")    # read by the driver alone
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    _sent.add(context.applicationId)


def with_package(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(plan, assigned=("__doc__",), updated=())
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark.sparkContext)
        return plan(spark, folder)
    return run
