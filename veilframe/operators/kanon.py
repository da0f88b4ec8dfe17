"""k-anonymity and distinct l-diversity by suppression.

The *class table* (quasi-identifiers, size, distinct values of sensitive columns) is one
partial aggregation; all metrics are one more over it, and rows are kept by a semi join
with the classes that survive. The join is null-safe, and Spark broadcasts the classes
where they are small and splits a class that is hot where they are not. No row passes
through a window of its class.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.columns import n_unique, qcol, unused
from veilframe.errors import PolicyError
from veilframe.operators.distinct import counted


@dataclass
class Suppressed:
    """The rows that stay, and what was measured."""

    df: DataFrame
    k: int
    l: int
    quasi_identifiers: list[str]
    sensitive: list[str]
    rows_total: int = 0
    rows_suppressed: int = 0
    classes_total: int = 0
    classes_below_k: int = 0
    k_achieved: int = 0
    l_achieved: dict[str, int] = field(default_factory=dict)
    homogeneous: dict[str, int] = field(default_factory=dict)
    classes_below_l: int = 0
    warnings: list[str] = field(default_factory=list)
    classes: DataFrame | None = None

    def done(self) -> None:
        """Lets go of the class table, once what reads it is written."""
        if self.classes is not None:
            self.classes.unpersist()

    @property
    def ratio(self) -> float:
        return self.rows_suppressed / self.rows_total if self.rows_total else 0.0


def checked(df: DataFrame, qis: list[str], k: int, sensitive: list[str], l: int) -> tuple[list[str], list[str]]:
    """Both lists without repeats, or an error."""
    if k < 2 or l < 1:
        raise PolicyError("k must be 2 and l must be 1 at least")
    qis, sensitive = list(dict.fromkeys(qis)), list(dict.fromkeys(sensitive))
    missing = [c for c in qis + sensitive if c not in df.columns]
    if missing:
        raise PolicyError(f"there is no column {', '.join(missing)}")
    if both := [c for c in sensitive if c in qis]:
        raise PolicyError(f"a quasi-identifier cannot be sensitive: {', '.join(both)}")
    return qis, sensitive


def class_table(df: DataFrame, qis: list[str], sensitive: list[str] = ()) -> DataFrame:
    """q0.., size, d0..: a row for each equivalence class; null is a value like any other."""
    rows = df.select(*[qcol(c).alias(f"q{i}") for i, c in enumerate(qis)], *[qcol(c).alias(f"s{i}") for i, c in enumerate(sensitive)])
    distinct = [n_unique(F.col(f"s{i}")).alias(f"d{i}") for i in range(len(sensitive))]
    return rows.groupBy(*[f"q{i}" for i in range(len(qis))]).agg(F.count(F.lit(1)).alias("size"), *distinct)


def survives(k: int, l: int, sensitive: int) -> Column:
    """Whether a class of the class table stays."""
    out = F.col("size") >= k
    if l > 1:
        out = reduce(lambda a, i: a & (F.col(f"d{i}") >= l), range(sensitive), out)
    return out


def class_metrics(classes: DataFrame, k: int, l: int, sensitive: list[str]) -> DataFrame:
    """One row of all that is measured, from the class table."""
    stays, full = survives(k, l, len(sensitive)), F.col("size") >= k
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    thin = reduce(lambda a, i: a | (F.col(f"d{i}") < l), range(len(sensitive)), F.lit(False))
    aggs = [
        zero(F.sum("size")).alias("rows_total"),
        zero(F.sum(F.when(~stays, F.col("size")))).alias("rows_suppressed"),
        F.count(F.lit(1)).alias("classes_total"),
        F.count_if(~full).cast("long").alias("classes_below_k"),
        zero(F.min(F.when(stays, F.col("size")))).alias("k_achieved"),
        F.count_if(full & thin).cast("long").alias("classes_below_l"),
    ]
    for i in range(len(sensitive)):
        aggs += [zero(F.min(F.when(full, F.col(f"d{i}")))).alias(f"l_achieved_{i}"), F.count_if(full & (F.col(f"d{i}") == 1)).cast("long").alias(f"homogeneous_{i}")]
    return classes.agg(*aggs)


def kept_rows(df: DataFrame, classes: DataFrame, qis: list[str], k: int, l: int, sensitive: int) -> DataFrame:
    """The rows whose class survives; the columns are df's, whatever their names."""
    row = unused(df, "row")
    left = df.select(F.struct(*[qcol(c) for c in df.columns]).alias(row), *[qcol(c).alias(f"{row}_q{i}") for i, c in enumerate(qis)])
    good = classes.where(survives(k, l, sensitive))
    on = reduce(lambda a, b: a & b, [F.col(f"{row}_q{i}").eqNullSafe(F.col(f"q{i}")) for i in range(len(qis))])
    kept = left.join(good, on, "left_semi")
    return kept.select(*[F.col(row).getField(c).alias(c) for c in df.columns])


def enforce(df: DataFrame, qis: list[str], k: int, sensitive: list[str] | None = None, l: int = 1) -> Suppressed:
    """Suppresses rows of classes below k rows or, for l of 2 or more, below l distinct values."""
    qis, sensitive = checked(df, qis, k, sensitive or [], l)
    out = Suppressed(df, k, l, qis, sensitive)
    if not qis:
        out.rows_total = out.k_achieved = df.count()
        if l > 1:
            out.warnings.append("l-diversity is not enforced: there are no quasi-identifiers")
        return out
    classes = class_table(df, qis, sensitive).persist()
    m = class_metrics(classes, k, l, sensitive).first().asDict()
    for name in ("rows_total", "rows_suppressed", "classes_total", "classes_below_k", "k_achieved"):
        setattr(out, name, m[name])
    out.classes_below_l = m["classes_below_l"] if l > 1 and sensitive else 0
    out.l_achieved = {c: m[f"l_achieved_{i}"] for i, c in enumerate(sensitive)}
    out.homogeneous = {c: m[f"homogeneous_{i}"] for i, c in enumerate(sensitive)}
    out.df, out.classes = kept_rows(df, classes, qis, k, l, len(sensitive)), classes
    return out


def value_table(df: DataFrame, qis: list[str], column: str) -> DataFrame:
    """q0.., s, size: how often each value of a column stands in each equivalence class."""
    rows = df.select(*[qcol(c).alias(f"q{i}") for i, c in enumerate(qis)], qcol(column).alias("s"))
    return rows.groupBy(*[f"q{i}" for i in range(len(qis))], "s").agg(F.count(F.lit(1)).alias("size"))


def cardinalities(df: DataFrame, columns: list[str]) -> list[tuple[str, int]]:
    """Distinct values of each column, most first."""
    if not columns:
        return []
    return sorted(((c, n.distinct) for c, n in counted(df, columns).items()), key=lambda x: -x[1])
