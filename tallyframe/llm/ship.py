"""Code for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless they find it in the working folder or on PYTHONPATH."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if ROOT in map(os.path.realpath, places) or "site-packages" in ROOT or getattr(sc, "_tallyframe_shipped", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tallyframe-code-")), "tallyframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "tallyframe")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
    sc.addPyFile(path)
    sc._tallyframe_shipped = True
