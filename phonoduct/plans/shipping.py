"""Send the package to the executors of a session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as an archive, once per application, so that executors need no installation."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    staged = tempfile.mkdtemp(prefix="package-")  # on the driver, which serves it to the executors
    archive = shutil.make_archive(os.path.join(staged, "phonoduct"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _SENT.add(app)
