"""Files of a release. Nothing appears under its name before it is whole."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.plans.engine import Released
from veilframe.plans.report import to_json, to_markdown


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _joined(spark: SparkSession, parts: list, target) -> None:
    """Part files one after another as one file: by the file system itself if it can, else as a stream of bytes."""
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
    for k, p in enumerate(parts[1:]):
        paths[k] = p
    if len(parts) == 1:
        fs.rename(parts[0], target)
        return
    try:
        fs.concat(parts[0], paths)
        fs.rename(parts[0], target)
    except (Py4JJavaError, PySparkException):  # most file systems have no concat
        out = fs.create(target, True)
        try:
            for p in parts:
                part = fs.open(p)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        finally:
            out.close()


def _one_file(spark: SparkSession, path: str, folders: list[str]) -> str:
    """The part files of folders, in the order of folders and of parts, as one file in place of ``path``."""
    fs, target = _fs(spark, path)
    found = []
    for folder in folders:
        statuses = [s for s in fs.listStatus(_path(spark, folder)) if s.getPath().getName().startswith("part-") and s.getLen()]
        found += sorted((s.getPath() for s in statuses), key=lambda p: p.getName())
    whole = _path(spark, f"{path}.{uuid.uuid4().hex}")
    if found:
        _joined(spark, found, whole)
    else:
        fs.create(whole, True).close()
    fs.delete(target, False)
    if not fs.rename(whole, target):
        raise OSError("the file cannot be put in place")
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """One CSV file with a header; nulls are empty. Tasks write its parts, which are joined in the order of rows."""
    spark = df.sparkSession
    fs, _ = _fs(spark, path)
    temp = f"{path}.{uuid.uuid4().hex}"
    options = {"sep": sep, "nullValue": "", "emptyValue": "", "escape": '"'}
    try:
        # One row: its names are the header, and an empty table has one too.
        names = spark.range(1).select(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(df.columns)])
        names.write.options(**options).csv(f"{temp}/header")
        df.write.options(**options).csv(f"{temp}/rows")
        return _one_file(spark, path, [f"{temp}/header", f"{temp}/rows"])
    finally:
        fs.delete(_path(spark, temp), True)


def write_lines(df: DataFrame, path: str) -> str:
    """One text file of a column of lines, in the order of rows; written in parts like a CSV file."""
    spark = df.sparkSession
    fs, _ = _fs(spark, path)
    temp = f"{path}.{uuid.uuid4().hex}"
    try:
        df.write.text(f"{temp}/lines")
        return _one_file(spark, path, [f"{temp}/lines"])
    finally:
        fs.delete(_path(spark, temp), True)


def write_parquet(df: DataFrame, path: str, **options) -> str:
    """A folder of Parquet files, written in parallel: the sink for large releases."""
    df.write.options(**options).mode("overwrite").parquet(path)
    return path


def write_text(spark: SparkSession, text: str, path: str, encoding: str = "utf-8") -> str:
    fs, target = _fs(spark, path)
    temp = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(text.encode(encoding)))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(temp, target)
    return path


def write_release(found: Released, folder: str, stem: str, parquet: bool = False) -> list[str]:
    """The table, and the report as JSON and Markdown."""
    spark = found.df.sparkSession
    base = f"{folder.rstrip('/')}/{stem}"
    table = write_parquet(found.df, f"{base}.sanitized.parquet") if parquet else write_csv(found.df, f"{base}.sanitized.csv")
    return [table, write_text(spark, to_json(found.report), f"{base}.report.json"), write_text(spark, to_markdown(found.report), f"{base}.report.md")]
