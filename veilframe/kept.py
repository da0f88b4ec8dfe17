"""Tables written once to the folder that a cluster shares, and deleted when the driver ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from veilframe.errors import VeilError

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; in local mode a temporary one if none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise VeilError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
    return found or sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: later passes read the columns that they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/veilframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for path, spark in _written.items():
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended before us
            pass


atexit.register(_remove)
