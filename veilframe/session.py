"""Sessions, and the code that executors need."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keys and tokens never show in plans, the UI or the event log.
    "spark.sql.redaction.string.regex": "(?i)[0-9a-f]{64,}",
}

_shipped: set[str] = set()


def session(master: str | None = None, app: str = "veilframe", **more: str) -> SparkSession:
    """A session with the settings that this library expects."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's default; whole texts make wide rows
        spark.conf.set(rows, "1000")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="veilframe-"), "veilframe.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
