"""Send this library to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Rows of a batch between the JVM and Python: documents are long, and both sides hold a batch or two.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of the session's executors, once a context.

    A session that leaves the batch size at Spark's default gets a smaller one.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_millrace_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "millrace.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, dirs, names in os.walk(_PACKAGE):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._millrace_shipped = True
