"""Ship the ``reco`` package to the executors.

Grouped-map functions (``applyInPandas``) are pickled by reference to their
module, so every Python worker must be able to import ``reco``.  This zips
the package once per SparkContext on the driver and registers it with
``SparkContext.addPyFile`` -- the programmatic form of ``--py-files``; Spark
then distributes it to every executor, including ones started later.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def package_zip() -> bytes:
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("reco", os.path.relpath(full, root)))
    return buf.getvalue()


def ship_package(spark: SparkSession) -> None:
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    d = tempfile.mkdtemp(prefix="reco-pyfiles-")  # driver-side staging; Spark serves it to executors
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = os.path.join(d, "reco.zip")
    with open(path, "wb") as fh:
        fh.write(package_zip())
    sc.addPyFile(path)
    _SHIPPED.add(key)
