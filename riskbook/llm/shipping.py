"""Make this package importable where Python runs for Spark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()
#: Rows that Spark hands to Python at once; whole texts come, so a batch must not hold too many.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Hand the package to the executors once per application, over Spark's own file service.

    Also lowers the session's Arrow batch size to ``BATCH_ROWS`` if it is larger.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="riskbook-package-")) / "riskbook_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.glob("riskbook/**/*.py")):
            archive.write(file, file.relative_to(root))
    context.addPyFile(str(target))
    _DONE.add(context.applicationId)
