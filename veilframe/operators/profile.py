"""Schema, personal data in columns, and statistics: all columns in one pass each."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.columns import clean, is_numeric, qcol
from veilframe.operators.distinct import counted
from veilframe.operators.phones import is_phone

#: What makes a string column categorical.
CATEGORICAL_MOST = 100
CATEGORICAL_SHARE = 0.05
#: Fixed value: the share of distinct values from which a column is near-unique.
NEAR_UNIQUE = 0.95
#: Hints in column names for each kind of personal data, in order.
NAME_HINTS = {
    "email": ("email", "e-mail", "mail", "電子郵件", "邮箱", "メール"),
    "phone": ("phone", "tel", "mobile", "cell", "電話", "手机", "手機", "電話番号"),
    "name": ("name", "fullname", "first_name", "last_name", "surname", "姓名", "名字", "名前", "full name"),
    "address": ("address", "addr", "street", "city", "zip", "postal", "住址", "地址", "住所"),
    "government_id": ("ssn", "nric", "id_number", "national_id", "身分證", "身份证", "マイナンバー", "taxid", "tax_id"),
    "date_of_birth": ("dob", "birthdate", "birth_date", "birthday", "生日", "誕生日"),
    "credit_card": ("credit_card", "card_number", "ccnum", "card"),
    "identifier": ("user_id", "customer_id", "account_id", "uuid", "guid"),
}
ID_TOKENS = ("id", "uuid", "guid", "identifier")
#: Patterns of values.
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
CARD = r"^\d{13,19}$"


def column_kind(kind: T.DataType, distinct: int, rows: int) -> str:
    """numeric, boolean, datetime, categorical or string."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if is_numeric(kind):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if rows and distinct <= CATEGORICAL_MOST and distinct / rows <= CATEGORICAL_SHARE:
        return "categorical"
    return "string"


def schema_profile(df: DataFrame, exact: bool = True) -> list[dict]:
    """Type, kind, distinct values (null counted), nulls, rows and range of each column.

    Exact counts shuffle 16 bytes for each distinct value of a task; without ``exact`` they are
    estimates, and one partial aggregation is all.
    """
    found = counted(df, df.columns, exact)
    out = []
    for f in df.schema.fields:
        n = found[f.name]
        logical = (f.metadata or {}).get("logical")
        kind = "datetime" if logical == "time" else column_kind(f.dataType, n.distinct, n.rows)
        entry = {"name": f.name, "dtype": f.dataType.simpleString(), "kind": kind, "n_unique": n.distinct, "null_count": n.nulls, "row_count": n.rows}
        if is_numeric(f.dataType):
            entry |= {"min": n.low, "max": n.high}
        out.append(entry)
    return out


@dataclass(frozen=True)
class Suggestion:
    """A kind of personal data, how sure that is, and why."""

    kind: str
    confidence: float
    reason: str


def _hinted(name: str, hint: str) -> bool:
    if not hint.isascii():
        return hint in name
    plain = lambda s: re.sub(r"[^a-z0-9]+", "_", s).strip("_")
    a, b = plain(name), plain(hint)
    return a == b or b in a.split("_") or a.replace("_", "") == b.replace("_", "")


def name_kind(name: str) -> str | None:
    """What a column's name says; the first kind that has a hint in it."""
    low = name.lower()
    for kind, hints in NAME_HINTS.items():
        if any(_hinted(low, h) for h in hints):
            return kind
    tokens = re.sub(r"[^a-z0-9]+", "_", low).split("_")
    return "identifier" if any(t in tokens for t in ID_TOKENS) else None


def is_email(s: Column) -> Column:
    return F.trim(s).rlike(EMAIL)


def is_card(s: Column) -> Column:
    digits = F.translate(s, " -", "")
    return digits.rlike(CARD) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def detection_sample(df: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` rows for detection: those with the least hash of all columns.

    Each task keeps so many of its own, and only they are shuffled. A table of no more rows is
    returned as it is.
    """
    if limit <= 0:
        return df.limit(0)
    if df.count() <= limit:
        return df
    columns = [F.array_sort(F.map_entries(qcol(f.name))) if isinstance(f.dataType, T.MapType) else qcol(f.name) for f in df.schema.fields]
    return df.orderBy(F.xxhash64(F.lit(seed), *columns)).limit(limit)


def _value_tests(c: Column, kind: T.DataType) -> dict[str, Column]:
    found = {}
    if isinstance(kind, T.StringType):
        found = {"email": is_email(c), "card": is_card(c)}
    if isinstance(kind, T.StringType) or is_numeric(kind):
        found["phone"] = is_phone(c.cast("string"))
    return found


def detect(df: DataFrame) -> dict[str, list[Suggestion]]:
    """Suggestions for each column, surest first, from names and from one pass over values."""
    found = counted(df, df.columns, True, _value_tests, ("email", "card", "phone"))
    out = {}
    for f in df.schema.fields:
        n = found[f.name]
        out[f.name] = suggestions(f.name, n.distinct, n.rows, n.shares.get("email"), n.shares.get("phone"), n.shares.get("card"), isinstance(f.dataType, T.StringType))
    return out


def suggestions(name: str, distinct: int, rows: int, email: float | None, phone: float | None, card: float | None, is_text: bool) -> list[Suggestion]:
    """What name and shares of matching values say together."""
    found: dict[str, Suggestion] = {}
    for kind, share, least, most in (("email", email, 0.80, 0.99), ("phone", phone, 0.70, 0.95), ("credit_card", card, 0.70, 0.99)):
        if share is not None and share >= least:
            found[kind] = Suggestion(kind, min(most, share), f"{share:.0%} of values match")
    share = distinct / rows if rows else 0.0
    if not found and is_text and rows > 20 and share > NEAR_UNIQUE:
        found["identifier"] = Suggestion("identifier", 0.60, "nearly all values differ")
    named = name_kind(name)
    if named in found:
        found[named] = Suggestion(named, min(0.99, found[named].confidence + 0.10), f"{found[named].reason}, and so does the name")
    elif named == "identifier":
        if share >= NEAR_UNIQUE:
            found[named] = Suggestion(named, 0.85, "the name, and nearly all values differ")
    elif named:
        found[named] = Suggestion(named, 0.55, "the name")
    out = sorted(found.values(), key=lambda s: -s.confidence)
    return out or [Suggestion("none", 1.0, "nothing matches")]


def column_counts(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, tuple[int, int, int]]:
    """(distinct values, null counted as one, nulls, rows) of each column, in one pass."""
    return {c: (n.distinct, n.nulls, n.rows) for c, n in counted(df, columns, exact).items()}


def category(distinct: int, nulls: int, rows: int) -> dict:
    """What is said of a column that holds no numbers: different values that are not null, and share of nulls."""
    return {"n_unique": distinct - (nulls > 0), "null_ratio": nulls / rows if rows else 1.0}


def _stats(df: DataFrame, c: str) -> Column:
    v = clean(qcol(c), df.schema[c].dataType).cast("double")
    ratio = F.when(F.count(v) == 0, 1.0).otherwise(F.count_if(qcol(c).isNull()) / F.count(F.lit(1)))
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)
    return F.struct(F.lit(c).alias("column_name"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), finite(F.min(v)).alias("minimum"), finite(F.max(v)).alias("maximum"), ratio.alias("null_ratio"))


def _correlation(df: DataFrame, a: str, b: str) -> Column:
    v, w = (clean(qcol(c), df.schema[c].dataType).cast("double") for c in (a, b))
    both = v.isNotNull() & w.isNotNull()
    x, y = F.when(both, v), F.when(both, w)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(~F.isnan(r) & (F.abs(r) < float("inf")), r).alias("r"))


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mean, std, minimum, maximum, null_ratio) of each number column."""
    return df.agg(F.array(*[_stats(df, c) for c in columns]).alias("s")).select(F.inline("s"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each pair of number columns, over the rows that have both; null for a constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*[_correlation(df, a, b) for a, b in pairs]).alias("p")).select(F.inline("p"))


def summary(df: DataFrame, columns: list[str], bins: int = 10) -> tuple[list, list, dict[str, list]]:
    """(statistics, correlations, histograms) of number columns, in two passes for all."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    first = df.agg(F.array(*[_stats(df, c) for c in columns]).alias("s"), F.array(*[_correlation(df, a, b) for a, b in pairs]).alias("p")).first()
    edges, aggs = {}, []
    for i, r in enumerate(first.s):
        lo, hi = r.minimum, r.maximum
        if lo is None or hi is None:
            continue
        n = bins if hi > lo else 1
        width = (hi - lo) / n
        edges[r.column_name] = [(lo + width * k, lo + width * (k + 1), f"h{i}_{k}") for k in range(n)]
        v = clean(qcol(r.column_name), df.schema[r.column_name].dataType).cast("double")
        at = F.least(F.greatest(F.ceil((v - lo) / width), F.lit(1)), F.lit(n)) if hi > lo else F.when(v.isNotNull(), F.lit(1))
        aggs += [F.count_if(at == k + 1).alias(f"h{i}_{k}") for k in range(n)]
    counts = df.agg(*aggs).first().asDict() if aggs else {}
    return first.s, first.p, {c: [[a, b, counts[name]] for a, b, name in e] for c, e in edges.items()}


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, lower, upper, n) of equal right-closed bins; one bin if all values are equal."""
    kind = df.schema[column].dataType
    v = clean(qcol(column), kind).cast("double")
    r = df.agg(F.min(v), F.max(v)).first()
    lo, hi = r
    empty = "bin int, lower double, upper double, n long"
    if lo is None or not (math.isfinite(lo) and math.isfinite(hi)):
        return df.sparkSession.createDataFrame([], empty)
    if lo == hi:
        bins, width = 1, 0.0
        at = F.lit(1)
    else:
        width = (hi - lo) / bins
        at = F.least(F.greatest(F.ceil((v - lo) / width), F.lit(1)), F.lit(bins)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(lo) + F.lit(width) * k
    out = all_.join(counts, "bin", "left")
    return out.select("bin", edge(F.col("bin") - 1).alias("lower"), edge(F.col("bin")).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))
