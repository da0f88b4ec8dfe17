"""Distinct values, nulls, ranges and matches of all columns, in one scan and one shuffle.

Each value becomes (column, 128-bit hash). Equal ones are counted within a task before
anything is shuffled, and a row of the shuffle stands for all occurrences of a value in a
task. Nothing is copied for each column as a plan with several distinct counts does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.columns import clean, is_numeric, n_unique, qcol

#: Tests of values by name, for a column and its type.
Tests = Callable[[Column, T.DataType], dict[str, Column]]


@dataclass(frozen=True)
class Counted:
    """A column: distinct values (null is one), nulls, rows, least and greatest number, shares of values that pass tests."""

    distinct: int = 0
    nulls: int = 0
    rows: int = 0
    low: float | None = None
    high: float | None = None
    shares: dict[str, float] = field(default_factory=dict)


def _hashes(c: Column, kind: T.DataType, i: int) -> tuple[Column, Column]:
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):  # hashes of these skip nulls within
        c = F.to_json(F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c, {"ignoreNullFields": "false"})
    there = c.isNotNull()
    return F.when(there, F.xxhash64(F.lit(i), c)), F.when(there, F.xxhash64(c, F.lit(i)))


def counted(df: DataFrame, columns: list[str], exact: bool = True, tests: Tests | None = None, names: tuple[str, ...] = ()) -> dict[str, Counted]:
    """Counts of each column; distinct values within some 5 % if not ``exact``. names: of the tests."""
    if not columns:
        return {}
    if not exact:
        return _estimated(df, {c: df.schema[c].dataType for c in columns}, tests, names)
    rows = counts(df, columns, tests, names).collect()  # a row a column
    found = {columns[r["column"]]: Counted(r.distinct, r.nulls, r.rows, r.low, r.high, {n: r[f"t{k}"] for k, n in enumerate(names) if r[f"t{k}"] is not None}) for r in rows}
    return {c: found.get(c, Counted()) for c in columns}


def counts(df: DataFrame, columns: list[str], tests: Tests | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """(column, distinct, nulls, rows, low, high, t0, ...): a row for each column by its place, none if df is empty."""
    kinds = {c: df.schema[c].dataType for c in columns}
    each = []
    for i, c in enumerate(columns):
        one, two = _hashes(qcol(c), kinds[c], i)
        number = clean(qcol(c), kinds[c]).cast("double") if is_numeric(kinds[c]) else F.lit(None).cast("double")
        found = tests(qcol(c), kinds[c]) if tests else {}
        flags = [found.get(n, F.lit(None)).cast("boolean").alias(f"t{k}") for k, n in enumerate(names)]
        each.append(F.struct(F.lit(i).alias("column"), one.alias("h1"), two.alias("h2"), number.alias("number"), *flags))
    values = df.select(F.inline(F.array(*each)))
    values = values.groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("number"), *[F.bool_or(f"t{k}").alias(f"t{k}") for k in range(len(names))])
    passed = [F.try_divide(F.sum(F.when(F.col(f"t{k}"), F.col("n")).otherwise(0)), F.sum(F.when(F.col(f"t{k}").isNotNull(), F.col("n")))).alias(f"t{k}") for k in range(len(names))]
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum(F.when(F.col("h1").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.sum("n").alias("rows"), F.min("number").alias("low"), F.max("number").alias("high"), *passed)


def _estimated(df: DataFrame, kinds: dict[str, T.DataType], tests: Tests | None, names: tuple[str, ...]) -> dict[str, Counted]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (name, kind) in enumerate(kinds.items()):
        c = qcol(name)
        aggs += [n_unique(c, False).alias(f"u{i}"), F.count_if(c.isNull()).alias(f"z{i}")]
        if is_numeric(kind):
            aggs += [F.min(clean(c, kind)).cast("double").alias(f"lo{i}"), F.max(clean(c, kind)).cast("double").alias(f"hi{i}")]
        aggs += [F.avg(x.cast("int")).alias(f"{n}{i}") for n, x in (tests(c, kind) if tests else {}).items()]
    r = df.agg(*aggs).first().asDict()
    return {name: Counted(r[f"u{i}"], r[f"z{i}"], r["rows"], r.get(f"lo{i}"), r.get(f"hi{i}"), {n: r[f"{n}{i}"] for n in names if r.get(f"{n}{i}") is not None}) for i, name in enumerate(kinds)}
