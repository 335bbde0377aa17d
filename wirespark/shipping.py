"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of this application, once; and bound the session's Arrow batches."""
    # Texts can be long: a batch of many rows would take much memory outside the heap, in each task.
    if int(spark.conf.get(BATCH)) > MOST_ROWS:
        spark.conf.set(BATCH, str(MOST_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_wirespark_shipped", False):
        return
    top = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="wirespark-"), "wirespark.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"wirespark/{p.relative_to(top)}")
    sc.addPyFile(at)
    sc._wirespark_shipped = True
