"""What both operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def finite(column: Column) -> Column:
    """Whether an array is there and holds finite numbers only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(True))


def packed(df: DataFrame, by: list[str], fields: list[str], name: str) -> DataFrame:
    """One row for each tile: its members as a list of structs."""
    return df.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias(name))


def matrix(members: pa.StructArray, field: str, dtype) -> np.ndarray:
    """The vectors of a tile as rows."""
    lists = members.field(field)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def tiles(column: pa.ListArray) -> Iterator[pa.StructArray]:
    for k in range(len(column)):
        yield column[k].values


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Batches of n rows meanwhile; a row holds a whole tile here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)
