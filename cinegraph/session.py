"""Makes the package importable in Python workers, on any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows that Spark sends to a Python worker at once: rows here hold whole texts, and both sides hold a batch.
BATCH_ROWS, DEFAULT_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2048"

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds this package to the workers' path, once for each application, and bounds the rows of a batch, if the session has Spark's default."""
    if spark.conf.get(BATCH_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cinegraph-")) / "cinegraph_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
