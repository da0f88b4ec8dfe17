"""Types of text columns from which every value comes back.

One aggregation gathers facts about all values of all columns. Facts merge in any order,
and the type of a column is the least of the lattice that holds them all:

- whole numbers: bigint, then decimal(38, 0), then text;
- numbers: double if each of them comes back from its double (15 significant digits always
  do; of more, those that the double prints), then a decimal of a fixed scale, then text;
- date; local time (a Z at the end is taken off if no other offset is there); an instant, if
  all values have an offset or Z; time of day, which stays text and is marked.

Patterns stand before every cast, so that nothing is typed by luck and no error quotes a value.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.columns import qcol

#: Shapes of text that is a value of each type.
_BOOLEAN = r"^(?i:true|false)$"
_WHOLE = r"^[+-]?\d+$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"^(?i:nan|[+-]?inf)$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_CLOCK = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
_LOCAL = rf"^{_CLOCK}Z?$"
_ZONED = rf"^{_CLOCK} ?(Z|[+-]\d{{2}}(:?\d{{2}})?)$"
_TIME = r"^\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"
_DIGITS = 38
#: Of doubles below this, fewer than 15 digits come back.
_LEAST = 1e-290


@F.pandas_udf(T.BooleanType())
def _comes_back(s: pd.Series) -> pd.Series:
    """Whether a number is the one that its double prints."""

    def same(text: str) -> bool:
        try:
            return Decimal(text) == Decimal(repr(float(text)))
        except InvalidOperation:
            return False

    return s.map(same, na_action="ignore")


def _double(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "(?i)^nan$", "NaN"), r"(?i)^([+-]?)inf$", "$1Infinity").try_cast("double")


def _local(c: Column) -> Column:
    return F.regexp_replace(c, "Z$", "").try_cast("timestamp_ntz")


def _instant(c: Column) -> Column:
    """A time with an offset; +02 and +0200 are +02:00."""
    c = F.regexp_replace(c, r" ?([+-]\d{2})$", "$1:00")
    return F.regexp_replace(c, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2").try_cast("timestamp")


@dataclass
class Facts:
    """What all values of a column have in common; values with more digits than a double keeps for sure are doubtful."""

    values: int = 0
    misses: dict[str, int] = field(default_factory=dict)
    doubtful: int = 0
    lossy: int = 0
    unscaled: int = 0
    before: int = 0
    after: int = 0

    def fits(self, kind: str) -> bool:
        return not self.misses[kind]


def _mantissa(number: Column) -> Column:
    return F.regexp_replace(number, r"^[+-]|[eE].*$", "")


def _significant(mantissa: Column) -> Column:
    return F.length(F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"^0+|0+$", ""))


def _staged(values: DataFrame) -> DataFrame:
    """Beside each value what facts about numbers ask for, each made once: the number, its mantissa, digits and size."""
    out = values.withColumn("number", F.when(F.col("value").rlike(_NUMBER), F.col("value")))
    out = out.withColumns({"mantissa": _mantissa(F.col("number")), "size": F.abs(F.col("number").try_cast("double"))})
    out = out.withColumn("digits", _significant(F.col("mantissa")))
    # Whether it may not come back from its double, and whether it does not.
    doubt = (F.col("digits") > 15) | ((F.col("size") < _LEAST) & (F.col("digits") > 0))
    lossy = (F.col("digits") > 17) | (F.col("size") == float("inf")) | ((F.col("size") == 0) & (F.col("digits") > 0))
    return out.withColumns({"doubt": F.coalesce(doubt, F.lit(False)), "lossy": F.coalesce(lossy, F.lit(False))})


def _aggregates() -> list[Column]:
    value, number, mantissa = F.col("value"), F.col("number"), F.col("mantissa")
    whole = number.isNotNull() & number.rlike(_WHOLE)
    fits = {
        "boolean": value.rlike(_BOOLEAN),
        "bigint": whole & number.try_cast("bigint").isNotNull(),
        "whole": whole,
        "number": number.isNotNull() | value.rlike(_SPECIAL),
        "date": value.rlike(_DATE) & value.try_cast("date").isNotNull(),
        "local": value.rlike(_LOCAL) & _local(value).isNotNull(),
        "instant": value.rlike(_ZONED) & _instant(value).isNotNull(),
        "time": value.rlike(_TIME),
    }
    fraction = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
    return [
        *[F.count_if(~F.coalesce(x, F.lit(False))).alias(kind) for kind, x in fits.items()],
        F.count(F.lit(1)).alias("values"),
        F.count_if("doubt").alias("doubtful"),
        F.count_if("lossy").alias("lossy"),
        F.count_if(value.rlike(_SPECIAL) | (number.isNotNull() & number.rlike("[eE]"))).alias("unscaled"),
        F.max(F.length(F.regexp_replace(F.substring_index(mantissa, ".", 1), "^0+", ""))).alias("before"),
        F.max(F.length(F.regexp_replace(fraction, "0+$", ""))).alias("after"),
    ]


_KINDS = ("boolean", "bigint", "whole", "number", "date", "local", "instant", "time")


def facts(df: DataFrame, columns: list[Column]) -> list[Facts]:
    """Facts about text columns, from all values; a second pass reads only columns with doubtful numbers.

    A row for each value, so that the compiled code is as short for many columns as for one.
    """
    if not columns:
        return []
    values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("column"), c.alias("value")) for i, c in enumerate(columns)]))).where("value is not null")
    found = {r["column"]: r for r in _staged(values).groupBy("column").agg(*_aggregates()).collect()}  # a row a column
    out = []
    for i in range(len(columns)):
        r = found.get(i)
        out.append(Facts(r["values"], {k: r[k] for k in _KINDS}, r.doubtful, r.lossy, r.unscaled, r.before or 0, r.after or 0) if r else Facts())
    unsure = [i for i, f in enumerate(out) if f.values and f.fits("number") and not f.fits("whole") and f.doubtful and not f.lossy]
    if unsure:
        asked = _staged(values.where(F.col("column").isin(unsure))).where("doubt").select("column", _comes_back("number").alias("back"))
        for r in asked.where(~F.col("back")).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect():
            out[r["column"]].lossy += r.n
    return out


def number_kind(f: Facts) -> str:
    """The least type that holds numbers without loss."""
    if f.fits("bigint"):
        return "bigint"
    if f.fits("whole"):
        return "decimal(38,0)" if f.before <= _DIGITS else "string"
    if not f.lossy:
        return "double"
    return f"decimal({_DIGITS},{f.after})" if not f.unscaled and f.before + f.after <= _DIGITS else "string"


def kind_of(f: Facts) -> str:
    """The least type of the lattice: a Spark type, or local, instant or time."""
    if not f.values:
        return "string"
    if f.fits("boolean"):
        return "boolean"
    if f.fits("number"):
        return number_kind(f)
    return next((k for k in ("date", "local", "instant", "time") if f.fits(k)), "string")


def converted(c: Column, kind: str, name: str) -> Column:
    """A text column as a type of the lattice."""
    if kind == "time":  # a time of day stays text and is marked
        return c.alias(name, metadata={"logical": "time"})
    cast = {"double": _double, "local": _local, "instant": _instant, "string": lambda x: x}.get(kind, lambda x: x.try_cast(kind))
    return cast(c).alias(name)


def typed(df: DataFrame, nulls: tuple[str, ...]) -> DataFrame:
    """Text columns as the least types that hold all their values; ``nulls`` are texts that stand for null."""
    columns = [F.when(~qcol(name).isin(*nulls), qcol(name)) for name in df.columns]
    kinds = [kind_of(f) for f in facts(df, columns)]
    return df.select(*[converted(c, kind, name) for c, kind, name in zip(columns, kinds, df.columns, strict=True)])
