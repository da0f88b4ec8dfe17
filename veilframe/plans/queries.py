"""A query for each operator on tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import transforms as X
from veilframe.functions.laplace import Noise, bounded, inverse
from veilframe.operators.kanon import class_metrics, class_table, enforce, value_table
from veilframe.operators.preflight import drop_each, drop_each_diverse, preflight
from veilframe.operators.profile import category, column_counts, correlations, detect, histogram, is_card, is_email, is_phone, numeric_stats, schema_profile
from veilframe.operators.utility import distinct_counts, utility
from veilframe.kept import shared_folder
from veilframe.plans.engine import release
from veilframe.plans.policy import Policy, Request, fold, suggest
from veilframe.config import Settings
from veilframe.session import ship
from veilframe.sinks import write_csv, write_lines, write_parquet, write_text
from veilframe.sources.tables import read_table

#: A key that is published on purpose: the queries are compared with SQL that holds it.
PUBLIC_KEY = b"veilframe public test key"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _hmac_sql(text: str, length: int, key: bytes = PUBLIC_KEY) -> str:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C))
    return f"left(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text})))), {length})"


def _trim_sql(x: str) -> str:
    return f"CASE WHEN contains(CAST({x} AS VARCHAR), '.') THEN rtrim(rtrim(CAST({x} AS VARCHAR), '0'), '.') ELSE CAST({x} AS VARCHAR) END"


def _bin_sql(v: str, width: str) -> str:
    lo = f"CAST(floor(CAST({v} AS DECIMAL(18,4)) / CAST({width} AS DECIMAL(18,4))) AS BIGINT) * CAST({width} AS DECIMAL(10,4))"
    return f"'[' || {_trim_sql(f'CAST({lo} AS DECIMAL(18,4))')} || ', ' || {_trim_sql(f'CAST({lo} + {width} AS DECIMAL(18,4))')} || ')'"


@_query("SELECT c_custkey, CASE WHEN length(c_name) <= 5 THEN NULL ELSE left(c_name, 3) || repeat('*', CAST(length(c_name) - 5 AS INTEGER)) || right(c_name, 2) END AS masked FROM customer")
def mask_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", X.mask(F.col("c_name"), 3, 2).alias("masked"))


@_query("SELECT n_nationkey, CASE WHEN length(n_name) > 9 THEN left(n_name, 5) || repeat('#', CAST(length(n_name) - 9 AS INTEGER)) || right(n_name, 4) ELSE left(n_name, CAST(floor(5 * ((length(n_name) - 1) / 9.0)) AS INTEGER)) || repeat('#', CAST(length(n_name) - floor(5 * ((length(n_name) - 1) / 9.0)) - floor(4 * ((length(n_name) - 1) / 9.0)) AS INTEGER)) || right(n_name, CAST(floor(4 * ((length(n_name) - 1) / 9.0)) AS INTEGER)) END AS masked FROM nation")
def mask_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select("n_nationkey", X.mask(F.col("n_name"), 5, 4, "#").alias("masked"))


@_query(f"SELECT c_custkey, {_hmac_sql('c_name', 16)} AS hashed FROM customer")
def hash_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", X.pseudonym(F.col("c_name"), PUBLIC_KEY, public=True).alias("hashed"))


@_query(f"SELECT c_custkey, {_hmac_sql('c_name', 16)} AS hashed FROM customer")
def hash_name_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", X.pseudonym(F.col("c_name"), PUBLIC_KEY).alias("hashed"))


@_query(f"SELECT c_custkey, 'tok_' || {_hmac_sql('CAST(c_custkey AS VARCHAR)', 12)} AS token FROM customer")
def token_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = X.apply_action("tokenize", F.col("c_custkey"), T.LongType(), {}, PUBLIC_KEY, public=True)
    return _t(spark, sf_dir, "customer").select("c_custkey", out.alias("token"))


@_query("SELECT event_id, CASE WHEN nullif(event_type, 'error') IS NOT NULL THEN '[REDACTED]' END AS redacted FROM events")
def redact_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", X.redact(F.nullif(F.col("event_type"), F.lit("error"))).alias("redacted"))


@_query(f"SELECT l_orderkey, l_linenumber, {_bin_sql('l_quantity', '10')} AS bin FROM lineitem")
def bin_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.numeric_bin(F.col("l_quantity"), T.DoubleType(), 10).alias("bin"))


@_query(f"SELECT c_custkey, {_bin_sql('c_acctbal', '2.5')} AS bin FROM customer")
def bin_acctbal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", X.numeric_bin(F.col("c_acctbal"), T.DoubleType(), "2.5").alias("bin"))


def _date(granularity: str, table: str, key: str, column: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _t(spark, sf_dir, table).select(key, X.date_truncate(F.col(column), T.TimestampNTZType(), granularity).alias("period"))

    return f


for _g, _f in (("year", "%Y"), ("month", "%Y-%m"), ("day", "%Y-%m-%d")):
    _queries[f"date_{_g}"] = _date(_g, "orders", "o_orderkey", "o_orderdate")
    _sql[f"date_{_g}"] = f"SELECT o_orderkey, strftime(o_orderdate, '{_f}') AS period FROM orders"


@_query("SELECT event_id, strftime(ts, '%Y-%m') AS period FROM events")
def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in text of several forms."""
    ts = F.col("ts")
    s = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "MM/dd/yyyy")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "MMMM d, yyyy"))
    return _t(spark, sf_dir, "events").select("event_id", X.date_truncate(s, T.StringType(), "month").alias("period"))


@_query("SELECT c_custkey, rpad(left(c_mktsegment, 3), CAST(length(c_mktsegment) AS INTEGER), '*') AS cut FROM customer")
def truncate_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", X.truncate(F.col("c_mktsegment"), 3).alias("cut"))


@_query(f"SELECT p_partkey, 'x' AS p_name, left(p_brand, 2) || repeat('*', CAST(length(p_brand) - 2 AS INTEGER)) AS p_brand, {_bin_sql('p_size', '5')} AS p_size, p_type FROM part")
def fold_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several policies as one projection."""
    ps = (Policy("p_name", "redact", {"replacement": "x"}), Policy("p_brand", "mask", {"keep_prefix": 2}), Policy("p_size", "numeric_bin", {"bin_width": 5}), Policy("p_retailprice", "drop"), Policy("p_none", "hash"))
    return fold(_t(spark, sf_dir, "part"), ps, PUBLIC_KEY)


@_query("SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part) WHERE n >= 12")
def kanon_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforce(_t(spark, sf_dir, "part"), ["p_brand", "p_type"], 12).df


_EVENTS_SQL = "SELECT event_id, nullif(event_type, 'error') AS kind, CAST(user_id % 40 AS BIGINT) AS grp FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.nullif(F.col("event_type"), F.lit("error")).alias("kind")
    return _t(spark, sf_dir, "events").select("event_id", kind, (F.col("user_id") % 40).cast("long").alias("grp"))


@_query(f"SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY kind, grp) AS n FROM ({_EVENTS_SQL})) WHERE n >= 50")
def kanon_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null quasi-identifiers are a class."""
    return enforce(_events(spark, sf_dir), ["kind", "grp"], 50).df


_LDIV = "SELECT p_brand, p_type, count(*) AS size, count(DISTINCT p_size) AS d FROM part GROUP BY ALL"


@_query(f"SELECT p.* FROM part p JOIN ({_LDIV}) c USING (p_brand, p_type) WHERE size >= 5 AND d >= 12")
def ldiv_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforce(_t(spark, sf_dir, "part"), ["p_brand", "p_type"], 5, ["p_size"], 12).df


_METRICS_SQL = """SELECT CAST(sum(size) AS BIGINT) AS rows_total, CAST(coalesce(sum(size) FILTER (NOT ok), 0) AS BIGINT) AS rows_suppressed, count(*) AS classes_total,
 count(*) FILTER (size < {k}) AS classes_below_k, CAST(coalesce(min(size) FILTER (ok), 0) AS BIGINT) AS k_achieved, count(*) FILTER (size >= {k} AND d < {l}) AS classes_below_l,
 CAST(coalesce(min(d) FILTER (size >= {k}), 0) AS BIGINT) AS l_achieved_0, count(*) FILTER (size >= {k} AND d = 1) AS homogeneous_0
 FROM (SELECT *, size >= {k} AND d >= {l} AS ok FROM ({classes}))"""


@_query(_METRICS_SQL.format(k=12, l=12, classes=_LDIV))
def ldiv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_metrics(class_table(_t(spark, sf_dir, "part"), ["p_brand", "p_type"], ["p_size"]), 12, 12, ["p_size"])


@_query("SELECT CAST(sum(size) AS BIGINT) AS rows_total, CAST(coalesce(sum(size) FILTER (size < 8), 0) AS BIGINT) AS rows_suppressed, count(*) AS classes_total, count(*) FILTER (size < 8) AS classes_below_k, CAST(coalesce(min(size) FILTER (size >= 8), 0) AS BIGINT) AS k_achieved, CAST(0 AS BIGINT) AS classes_below_l FROM (SELECT count(*) AS size FROM customer GROUP BY c_nationkey, c_mktsegment)")
def kanon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_metrics(class_table(_t(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]), 8, 1, [])


@_query("SELECT kind, grp, count(*) AS size FROM (" + _EVENTS_SQL + ") GROUP BY ALL")
def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_table(_events(spark, sf_dir), ["kind", "grp"]).select(F.col("q0").alias("kind"), F.col("q1").alias("grp"), "size")


_QIS = ["p_brand", "p_type", "p_size"]
_ONE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS left_out, CAST(coalesce(sum(n) FILTER (n < 5), 0) AS BIGINT) AS rows_suppressed, CAST(sum(n) AS BIGINT) AS rows_total FROM (SELECT count(*) AS n FROM part GROUP BY {', '.join(x for x in _QIS if x != c)})" for c in _QIS)


@_query(_ONE_SQL)
def preflight_drop_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_each(class_table(_t(spark, sf_dir, "part"), _QIS), _QIS, [0, 1, 2], 5)


def _share_sql(columns: list[str]) -> str:
    return f"(SELECT coalesce(sum(n) FILTER (n < 5), 0) / sum(n) FROM (SELECT count(*) AS n FROM part GROUP BY {', '.join(columns)}))"


# Three columns: two steps at most. Ties go to more distinct values, then to the name.
_STEPS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS one, '{d}' AS two, {_share_sql([x for x in _QIS if x != c])} AS r1, {_share_sql([x for x in _QIS if x not in (c, d)])} AS r2" for c in _QIS for d in _QIS if c != d)


@_query(f"""WITH base AS (SELECT {_share_sql(_QIS)} AS r), many AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS u FROM part" for c in _QIS)}),
 goal AS (SELECT r, CASE WHEN r > 0.5 THEN 0.5 ELSE 0.1 END AS t FROM base),
 best AS (SELECT s.* FROM ({_STEPS_SQL}) s JOIN many a ON a.c = one JOIN many b ON b.c = two ORDER BY r1, a.u DESC, one, r2, b.u DESC, two LIMIT 1)
 SELECT CAST(1 AS INTEGER) AS step, one AS left_out, round(r1, 6) AS ratio FROM best, goal WHERE r > t UNION ALL SELECT 2, two, round(r2, 6) FROM best, goal WHERE r > t AND r1 > t""")
def preflight_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preflight(_t(spark, sf_dir, "part"), _QIS, 5)
    steps = found["plan"]["steps"] if found["plan"] else []
    return spark.createDataFrame([(i + 1, s.column, round(s.ratio, 6)) for i, s in enumerate(steps)], "step int, left_out string, ratio double")


_U_SQL = "((CAST('0x' || left(sha256(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)), 8) AS BIGINT) + 0.5) / 4294967296.0)"


@_query(f"SELECT l_orderkey, l_linenumber, round(greatest(1.0, least(50.0, greatest(1.0, least(50.0, l_quantity)) + CASE WHEN u < 0.5 THEN 24.5 * ln(2 * u) ELSE -24.5 * ln(2 * (1 - u)) END)), 6) AS noised FROM (SELECT *, {_U_SQL} AS u FROM lineitem)")
def dp_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded Laplace noise from fixed uniform numbers."""
    u = (F.conv(F.left(F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber"), 256), F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = Noise(2.0, 1.0, 50.0)
    v = bounded(F.col("l_quantity"), inverse(u, noise.scale), noise.lower, noise.upper)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(v, 6).alias("noised"))


@_query("SELECT count(*) AS n, true AS within, true AS stable FROM lineitem")
def dp_release_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noised release lies in its bounds, and is the same when it is read again."""
    request = Request((Policy("l_quantity", "dp_laplace"), Policy("l_returnflag", is_quasi_identifier=True)), dp={"l_quantity": {"epsilon": 2.0, "lower": 1.0, "upper": 50.0}})
    out = release(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), request, Settings(), PUBLIC_KEY).df
    both = out.withColumn("turn", F.lit(1)).union(out.withColumn("turn", F.lit(-1)))
    left = both.groupBy(*out.columns).agg(F.sum("turn").alias("left"), F.count_if(F.col("turn") == 1).alias("n"))
    return left.agg(F.sum("n").alias("n"), F.bool_and(F.col("l_quantity").between(1.0, 50.0)).alias("within"), F.bool_and(F.col("left") == 0).alias("stable"))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS row_count, {lo} AS minimum, {hi} AS maximum FROM customer" for c, lo, hi in [(c, *((f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if c in ("c_custkey", "c_nationkey", "c_acctbal") else ("CAST(NULL AS DOUBLE)",) * 2)) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]))
def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e["name"], e["n_unique"], e["null_count"], e["row_count"], e.get("min"), e.get("max")) for e in schema_profile(_t(spark, sf_dir, "customer"))]
    return spark.createDataFrame(rows, "name string, n_unique long, null_count long, row_count long, minimum double, maximum double")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS minimum, max({c}) AS maximum, CAST(count(*) FILTER ({c} IS NULL) / count(*) AS DOUBLE) AS null_ratio FROM lineitem" for c in _NUMBERS))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = numeric_stats(_t(spark, sf_dir, "lineitem"), list(_NUMBERS))
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@_query("WITH r AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM customer), c AS (SELECT CAST(least(greatest(ceil((c_acctbal - lo) / w), 1), 10) AS INTEGER) AS bin, count(*) AS n FROM customer, r GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, round(lo + w * (i - 1), 6) AS lower, round(lo + w * i, 6) AS upper, coalesce(n, 0) AS n FROM r, range(1, 11) t(i) LEFT JOIN c ON c.bin = i")
def histogram_acctbal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(_t(spark, sf_dir, "customer"), "c_acctbal").withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@_query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i:]))
def correlation_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations(_t(spark, sf_dir, "lineitem"), list(_NUMBERS)).withColumn("r", F.round("r", 8))


@_query("WITH kept AS (SELECT p_brand, p_size // 5 AS b FROM part QUALIFY count(*) OVER (PARTITION BY p_brand) >= 5), n AS (SELECT count(*) AS rows_after, count(DISTINCT b) AS bins FROM kept), t AS (SELECT count(*) AS rows_before, count(DISTINCT p_size) AS sizes FROM part) SELECT round(100 * (rows_after / rows_before) * (3 / 4.0) * ((1.0 + round(bins / sizes, 4) + 0.3) / 3), 1) AS score, rows_before, rows_after FROM n, t")
def utility_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part").select("p_brand", "p_size", "p_name", "p_type")
    ps = (Policy("p_brand", is_quasi_identifier=True), Policy("p_size", "numeric_bin", {"bin_width": 5}), Policy("p_name", "hash"), Policy("p_type", "drop"))
    out = enforce(fold(df, ps, PUBLIC_KEY, public=True), ["p_brand"], 5)
    after = out.rows_total - out.rows_suppressed
    worth = utility(distinct_counts(df, df.columns), distinct_counts(out.df, out.df.columns), out.rows_total, after, {p.column: p.action for p in ps})
    return spark.createDataFrame([(worth["overall_score"], out.rows_total, after)], "score double, rows_before long, rows_after long")


@_query(r"SELECT doc_id, list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$'))[1] AS email, list_filter(w, lambda x: regexp_full_match(replace(x, '-', ''), '[0-9]{13,19}'))[1] AS long_number FROM (SELECT doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS w FROM documents)")
def pii_first_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each whole text that passes each value test of the detector."""
    w = F.split("text", r"[\x20\x09-\x0D]+")
    emails, numbers = F.filter(w, is_email), F.filter(w, lambda x: F.translate(x, "-", "").rlike(r"^\d{13,19}$"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.get(emails, 0).alias("email"), F.get(numbers, 0).alias("long_number"))


@_query(r"SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$'))) AS emails, len(list_filter(w, lambda x: regexp_full_match(replace(x, '-', ''), '[0-9]{13,19}'))) AS long_numbers FROM (SELECT doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS w FROM documents)")
def pii_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value tests of the detector on every word of each whole text: how many words pass."""
    w = F.split("text", r"[\x20\x09-\x0D]+")
    emails, numbers = F.filter(w, is_email), F.filter(w, lambda x: F.translate(x, "-", "").rlike(r"^\d{13,19}$"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(emails).cast("long").alias("emails"), F.size(numbers).cast("long").alias("long_numbers"))


_LUHN_SQL = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(c[i] AS INTEGER) WHEN CAST(c[i] AS INTEGER) > 4 THEN 2 * CAST(c[i] AS INTEGER) - 9 ELSE 2 * CAST(c[i] AS INTEGER) END)) % 10 = 0"


@_query(f"SELECT avg(CAST(regexp_matches(n, '^[2-9]') AS INTEGER)) AS phone, avg(CAST({_LUHN_SQL} AS INTEGER)) AS card FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '2') AS n, '411111111111' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS c FROM customer)")
def pii_value_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of values that pass each test, for numbers made of keys."""
    n = F.lpad(F.col("c_custkey").cast("string"), 7, "2")
    rows = _t(spark, sf_dir, "customer").select(F.concat(F.lit("+1 212 "), F.left(n, F.lit(3)), F.lit("-"), F.right(F.concat(n, n), F.lit(4))).alias("phone"), F.concat(F.lit("411111111111"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")).alias("card"))
    return rows.agg(F.avg(is_phone(F.col("phone")).cast("int")).alias("phone"), F.avg(is_card(F.col("card")).cast("int")).alias("card"))


_FLAG = f"SELECT '[REDACTED]' AS c_name, c_nationkey, {_bin_sql('c_acctbal', '1000')} AS c_acctbal, c_mktsegment FROM customer"


@_query(f"SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM ({_FLAG})) WHERE n >= 5")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with names redacted, keys dropped and balances binned, in groups of 5 or more."""
    ps = (Policy("c_name", "redact"), Policy("c_custkey", "drop"), Policy("c_acctbal", "numeric_bin", {"bin_width": 1000}), Policy("c_mktsegment", is_quasi_identifier=True))
    return enforce(fold(_t(spark, sf_dir, "customer"), ps, PUBLIC_KEY), ["c_mktsegment"], 5).df


@_query(f"SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_quantity, l_shipdate) AS n FROM (SELECT {_hmac_sql('CAST(l_orderkey AS VARCHAR)', 16)} AS l_orderkey, {_bin_sql('l_quantity', '25')} AS l_quantity, l_returnflag, strftime(l_shipdate, '%Y-%m') AS l_shipdate, l_discount FROM lineitem)) WHERE n >= 5")
def full_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a release but noise: transforms, classes, suppression, report."""
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate", "l_discount")
    ps = (Policy("l_orderkey", "hash"), Policy("l_quantity", "numeric_bin", {"bin_width": 25}, True), Policy("l_returnflag", is_quasi_identifier=True), Policy("l_shipdate", "date_truncate", {"granularity": "month"}, True))
    return release(df, Request(ps, k=5), Settings(), PUBLIC_KEY, public=True).df


# --- sources and sinks: what is written is read again ---------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share."""
    return f"{shared_folder(spark)}/veilframe-queries/{uuid.uuid4().hex}"


@_query("SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'second line' AS note, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance, c_custkey % 2 = 0 AS even FROM customer")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through a CSV file with quotes, line breaks and nulls, typed again."""
    note = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nsecond line'))
    df = _t(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("balance"), (F.col("c_custkey") % 2 == 0).alias("even"))
    return read_table(spark, write_csv(df, f"{_folder(spark)}/customer.csv"))


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def source_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through delimited text whose separator is found from its lines."""
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("double").alias("price"))
    return read_table(spark, write_csv(df, f"{_folder(spark)}/orders.txt", sep="|"))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || ' -- it''s (1), /* no */ comment' AS n_name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS BIGINT) END AS n_regionkey FROM nation")
def source_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through a dump of INSERT statements with comment marks in its strings."""
    rows = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    values = ",\n".join(f"({r.n_nationkey}, '{r.n_name} -- it''s (1), /* no */ comment', {r.n_regionkey or 'NULL'})" for r in rows)
    text = f"-- a dump\nCREATE TABLE nation (n_nationkey int);\nINSERT INTO nation (n_nationkey, `n_name`, [n_regionkey]) VALUES\n{values};\n"
    return read_table(spark, write_text(spark, text, f"{_folder(spark)}/nation.sql"))


@_query("SELECT 1234567890123456000 + o_orderkey AS id, '99' || lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS wide, CAST(epoch(o_orderdate) AS BIGINT) - 7200 AS seconds, '3.' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS fine FROM orders")
def source_wide_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 19 to 21 digits and times with an offset, through a CSV file: no value changes."""
    key = F.col("o_orderkey").cast("string")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    df = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1234567890123456000).alias("id"), F.concat(F.lit("99"), F.lpad(key, 18, "0")).alias("wide"), at.alias("at"), F.concat(F.lit("3."), F.lpad(key, 20, "0")).alias("fine"))
    back = read_table(spark, write_csv(df, f"{_folder(spark)}/ids.csv"))
    return back.select("id", F.col("wide").cast("string").alias("wide"), F.unix_seconds("at").alias("seconds"), F.col("fine").cast("string").alias("fine"))


@_query("SELECT CAST(18446744069414584320::HUGEINT + o_orderkey AS VARCHAR) AS id, o_orderpriority || ' -- it''s; (1),' || chr(10) || '(''no'')' AS note, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_totalprice AS DOUBLE) END AS price FROM orders")
def source_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders through a dump: hexadecimal numbers of 64 bits, and strings that look like SQL over two lines."""
    hex_ = F.concat(F.lit("0xFFFFFFFF"), F.lpad(F.hex("o_orderkey"), 8, "0"))
    note = F.concat(F.lit("'"), "o_orderpriority", F.lit(" -- it''s; (1),\n(''no'')'"))
    price = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice").cast("double").cast("string")).otherwise("NULL")
    rows = _t(spark, sf_dir, "orders").select(F.concat(F.lit("("), F.concat_ws(", ", hex_, note, price), F.lit("),")).alias("line"))
    one = lambda text: spark.range(1).select(F.lit(text).alias("line"))
    whole = one("/* a dump; */ INSERT INTO orders (id, note, price) VALUES").union(rows).union(one(";"))
    return read_table(spark, write_lines(whole, f"{_folder(spark)}/orders.sql")).withColumn("id", F.col("id").cast("string"))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || ' - zażółć gęślą jaźń' AS name FROM nation")
def source_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in an encoding that is told from its lines."""
    rows = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    text = "n_nationkey,name\n" + "".join(f"{r.n_nationkey},{r.n_name} - zażółć gęślą jaźń\n" for r in rows)
    return read_table(spark, write_text(spark, text, f"{_folder(spark)}/nation.csv", "cp1250"))


@_query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size IS NOT NULL")
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through a folder of Parquet files."""
    return read_table(spark, write_parquet(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), f"{_folder(spark)}/part.parquet"))


# --- schema, detection, suggestions, reports -------------------------------------------------

_KINDS = ("event_id", "user_id", "event_type", "ts")


@_query("SELECT 'event_id' AS name, 'numeric' AS kind UNION ALL SELECT 'user_id', 'numeric' UNION ALL SELECT 'ts', 'datetime' UNION ALL SELECT 'event_type', CASE WHEN count(DISTINCT event_type) <= 100 AND count(DISTINCT event_type) / count(*) <= 0.05 THEN 'categorical' ELSE 'string' END FROM events")
def schema_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema_profile(_t(spark, sf_dir, "events").select(*_KINDS))
    return spark.createDataFrame([(e["name"], e["kind"]) for e in found], "name string, kind string")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an address, a card and a phone number made of their keys."""
    key = F.col("c_custkey").cast("string")
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.concat(F.lit("u"), key, F.lit("@site.example")).alias("contact"), F.concat(F.lit("+1 212 555-"), F.lpad(key, 4, "0")).alias("line"), F.lit("4111111111111111").alias("card_number"))


@_query("""SELECT 'contact' AS name, 'email' AS kind, CAST(0.99 AS DOUBLE) AS confidence UNION ALL SELECT 'line', 'phone', 0.95 UNION ALL SELECT 'card_number', 'credit_card', 0.99
 UNION ALL SELECT 'c_mktsegment', 'none', 1.0 UNION ALL SELECT 'c_acctbal', 'none', 1.0 UNION ALL SELECT 'c_custkey', 'none', 1.0""")
def detect_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest kind of personal data in each column, from all rows."""
    found = detect(_people(spark, sf_dir))
    return spark.createDataFrame([(c, s[0].kind, round(s[0].confidence, 2)) for c, s in found.items()], "name string, kind string, confidence double")


@_query("""SELECT 'contact' AS name, 'hash' AS action, false AS qi, 'pii_kind' AS source UNION ALL SELECT 'line', 'mask', false, 'pii_kind' UNION ALL SELECT 'card_number', 'mask', false, 'pii_kind'
 UNION ALL SELECT 'c_mktsegment', 'retain', count(DISTINCT c_mktsegment) * 5 <= count(*), 'kind' FROM customer UNION ALL SELECT 'c_acctbal', 'retain', count(DISTINCT c_acctbal) * 5 <= count(*), 'kind' FROM customer
 UNION ALL SELECT 'c_custkey', 'retain', false, 'kind'""")
def policy_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _people(spark, sf_dir)
    found = detect(df)
    rows = [suggest(e, found[e["name"]][0].kind, 5) for e in schema_profile(df)]
    return spark.createDataFrame([(s["column"], s["action"], s["is_quasi_identifier"], s["source"]) for s in rows], "name string, action string, qi boolean, source string")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_unique, count(*) FILTER ({c} IS NULL) / count(*) AS null_ratio FROM ({_EVENTS_SQL})" for c in ("kind", "grp")))
def categorical_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {c: category(*n) for c, n in column_counts(_events(spark, sf_dir), ["kind", "grp"]).items()}
    return spark.createDataFrame([(c, v["n_unique"], v["null_ratio"]) for c, v in found.items()], "name string, n_unique long, null_ratio double")


_DIVERSE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS left_out, CAST(coalesce(sum(n) FILTER (n < 5 OR a < 5 OR b < 5), 0) AS BIGINT) AS rows_suppressed, CAST(sum(n) AS BIGINT) AS rows_total FROM (SELECT count(*) AS n, count(DISTINCT p_size) AS a, count(DISTINCT p_name) AS b FROM part GROUP BY {x})" for c, x in (("p_brand", "p_type"), ("p_type", "p_brand")))


@_query(_DIVERSE_SQL)
def preflight_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows lost to small classes and to those with less than five sizes or names, each column left out in turn."""
    df, qis = _t(spark, sf_dir, "part"), ["p_brand", "p_type"]
    return drop_each_diverse([value_table(df, qis, c) for c in ("p_size", "p_name")], qis, [0, 1], 5, 5)


@_query("SELECT CAST(count(*) AS BIGINT) AS rows_total, CAST(count(*) FILTER (n < 8) AS BIGINT) AS rows_suppressed, round(count(*) FILTER (n < 8) / count(*), 6) AS ratio, CAST(min(n) FILTER (n >= 8) AS BIGINT) AS k_achieved, CAST(count(*) FILTER (n >= 8) AS BIGINT) AS rows_after, round(avg(p_size) FILTER (n >= 8), 6) AS mean_size, CAST(count(DISTINCT p_type) FILTER (n >= 8) AS BIGINT) AS types FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report of a release says of classes and of the released columns."""
    ps = (Policy("p_brand", is_quasi_identifier=True), Policy("p_name", "drop"))
    found = release(_t(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_name"), Request(ps, k=8), replace(Settings(), soft_cap=0.9, hard_cap=0.95), PUBLIC_KEY).report
    k, v = found["k_anonymity"], found["validation"]
    row = (k["rows_total"], k["rows_suppressed"], round(k["suppression_ratio"], 6), k["k_achieved"], v["rows_after"], round(v["columns"]["p_size"]["mean"], 6), v["columns"]["p_type"]["n_unique"])
    return spark.createDataFrame([row], "rows_total long, rows_suppressed long, ratio double, k_achieved long, rows_after long, mean_size double, types long")


def queries() -> dict[str, Query]:
    from veilframe.plans import release_queries  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


