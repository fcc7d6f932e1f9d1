"""Session helpers: defaults for tests and local runs, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects: UTC and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each Spark application.

    Arrow batches are kept to some megabytes, unless the session says otherwise:
    rows can be long texts or whole fields, and a count of rows does not bound them.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if getattr(sc, "_gridspan_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="gridspan-"), "gridspan.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(path)
        sc._gridspan_shipped = sc.applicationId
    return spark
