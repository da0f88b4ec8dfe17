"""Names, strings and counts that must not depend on Spark's defaults."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def qcol(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def n_unique(c: Column, exact: bool = True) -> Column:
    """Number of distinct values, null counted as one; an estimate within some 5 % if not ``exact``."""
    return ((F.count_distinct(c) if exact else F.approx_count_distinct(c)) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).cast("long")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def clean(c: Column, kind: T.DataType) -> Column:
    """A number with NaN taken as null."""
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


@F.pandas_udf(T.StringType())
def _float_text(s: pd.Series) -> pd.Series:
    return s.map(repr, na_action="ignore")


def text(c: Column, kind: T.DataType) -> Column:
    """A value as Python's ``str`` writes it."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = (F.abs(c) >= 0.001) & (F.abs(c) < 1e7) & (c == F.floor(c))
        return F.when(plain, F.concat(F.floor(c).cast("string"), F.lit(".0"))).otherwise(_float_text(c.cast("double")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        part = F.date_format(c, "SSSSSS")
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)))
    return c.cast("string")
