"""Python workers find this package from wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Send the named packages next to this one to all workers, once per application.

    Where the package is installed on the executors, or on their PYTHONPATH, that copy and this are the same.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="quadrat-code-"), "quadrat_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for package in packages:
            for folder, _, names in os.walk(os.path.join(root, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
