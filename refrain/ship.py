"""Making the package known to the executors' Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, once a context; Spark itself keeps and serves the file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="refrain-")
    path = os.path.join(folder, "refrain_package.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
