"""Give Python workers this package, however the driver found it, and batches of bounded size."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"  # rows are whole texts and series: 10,000 of them, or 64 MB, are more than two tasks should hold beside a heap
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session's Python files, once for each application; bound Arrow batches unless the application does so."""
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        top = Path(__file__).resolve().parents[1]
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        path = os.path.join(tempfile.mkdtemp(), "lagwise_sources.zip")
        Path(path).write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(path)  # the driver serves it to the executors
    return spark
