"""Sends this package to executors, for the few operators that run Python there."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        folder = tempfile.mkdtemp(prefix="locusframe-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/locusframe_code.zip", "w") as z:
            for top, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(top, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        spark.sparkContext.addPyFile(f"{folder}/locusframe_code.zip")
    _SHIPPED.add(app)
