"""Where intermediate tables go, and ranks without a single task."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


#: A table of so many rows at most may be sent to every executor.
BROADCAST_ROWS = 100_000
#: Bytes up to which Spark may broadcast by itself within ``bounded``: of files, and of rows as it has counted them.
_BY_FILES, _BY_ROWS = 256 << 10, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode one of this process where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="veilframe-")
    return "file://" + _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before us
            pass


atexit.register(_remove)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again.

    This cuts the lineage: what follows survives lost executors without computing it
    anew, and its size is known to the optimizer. The table goes when the driver ends, or
    before, by ``drop`` or ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A kept table, marked for a broadcast if it has ``rows`` short rows at most.

    A larger one stays as it is, and Spark joins it by sorting or splits it where it is hot.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _bytes(size: str) -> int:
    """Bytes of one of Spark's sizes, as 10485760b, 256k or -1."""
    n, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)[a-z]*\s*", size.lower()).groups()
    return int(n) << 10 * "bkmgtp".index(unit or "b")


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark broadcasts small tables only, but for those of ``sized``.

    By itself it goes by the size of files, up to 10 MB. Names and lists of numbers that repeat
    take many times that as rows, and more where lists are taken apart; the driver has to hold
    each such table while it is sent. Smaller settings of the session hold.
    """
    files, rows = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, own = {key: spark.conf.get(key, None) for key in (files, rows)}, spark.conf.get(files)
    for key, most in ((files, _BY_FILES), (rows, _BY_ROWS)):
        spark.conf.set(key, str(min(most, _bytes(before[key] or own))))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def looked_up(rows: DataFrame, table: DataFrame, key: str, values: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """Kept rows with the values of a kept table: one row a key (null is one), and in n how many rows hold it.

    A table of ``most`` rows at most is broadcast. Of a larger one, the keys with more than a
    thousandth of all rows are, less than a thousand; the shuffle of the others has no hot key.
    """
    table = table.select(F.col(key).alias("_key"), *values, "n")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table.drop("n")), same, "left").drop("_key")
    line = (table.agg(F.sum("n")).first()[0] or 0) / 1000
    hot, rest = F.broadcast(table.where(F.col("n") > line).drop("n")), table.where(F.col("n") <= line).drop("n")
    one = rows.join(hot, same).drop("_key")
    return one.union(rows.join(hot.select("_key"), same, "left_anti").join(rest, same, "left").drop("_key"))


def drop(*tables: DataFrame) -> None:
    """Deletes kept tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_kept_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what was kept within, but for tables put into the list.

    The shuffle files of plans that are done with go too: Spark's cleaner removes them
    once the driver's memory is collected.
    """
    before, stay = set(_written), []
    yield stay
    paths = {getattr(df, "_kept_path", None) for df in stay}
    for path in [p for p in _written if p not in before and p not in paths]:
        _delete(_written.pop(path), path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """Adds a 0-based global rank by ``order`` without a window over all rows.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition
    plus the rows of all partitions before it. Only one count per partition meets in
    one task.
    """
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = keep(placed.withColumn("_part", F.shiftright("_id", 33)), name)
    first = placed.groupBy("_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = first.select("_part", "_first", F.coalesce(total, F.lit(0)).alias("_before"))
    out = placed.join(first, "_part").withColumn(rank, F.col("_id") - F.col("_first") + F.col("_before"))
    return out.drop("_id", "_part", "_first", "_before")
