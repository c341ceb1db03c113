"""Analytics over labelled point events, on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package: as an archive that Spark sends to every executor, once an application.

    Where the package is installed on the workers already, the same files are only found twice.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="eventloom-package-")  # on the driver alone; Spark copies the archive from here
    archive = os.path.join(folder, "eventloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path, _, names in os.walk(here):
            for name in names:
                if name.endswith((".py", ".json")):
                    full = os.path.join(path, name)
                    out.write(full, os.path.join("eventloom", os.path.relpath(full, here)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
