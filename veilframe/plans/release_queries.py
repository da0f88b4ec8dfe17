"""Queries of what surrounds a release: guardrails, reports, comparisons, budgets, names and odd files."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.columns import text
from veilframe.config import Settings
from veilframe.errors import BudgetError, ParseError, RiskError
from veilframe.functions.ledger import Ledger
from veilframe.kept import shared_folder
from veilframe.operators.distinct import counted
from veilframe.operators.kanon import cardinalities, enforce
from veilframe.operators.profile import detect, detection_sample, is_email, schema_profile
from veilframe.plans import engine
from veilframe.plans.policy import Policy, Request, derived_key, offered_params, sensitive_columns, suggest
from veilframe.plans.queries import PUBLIC_KEY, _bin_sql, _folder, _hmac_sql, _query, _t
from veilframe.plans.report import to_json, to_markdown
from veilframe.sinks import write_csv, write_lines, write_release
from veilframe.sources.tables import read_table

_LOOSE = replace(Settings(), soft_cap=0.9, hard_cap=0.95)


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders")
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are shorter than the header end in nulls."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = F.concat_ws(",", "o_orderkey", day, F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))))
    rows = _t(spark, sf_dir, "orders").select(line.alias("line"))
    return read_table(spark, write_lines(spark.range(1).select(F.lit("o_orderkey,day,priority").alias("line")).union(rows), f"{_folder(spark)}/orders.csv"))


@_query("SELECT count(*) AS refused FROM orders WHERE o_orderkey % 7 = 0")
def long_rows_are_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows an error says are longer than the header; it says nothing else."""
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit("secret")))
    rows = _t(spark, sf_dir, "orders").select(line.alias("line"))
    path = write_lines(spark.range(1).select(F.lit("o_orderkey,status").alias("line")).union(rows), f"{_folder(spark)}/orders.csv")
    try:
        read_table(spark, path)
        n = 0
    except ParseError as e:
        n = int(re.fullmatch(r"(\d+) rows have more fields than the header", str(e))[1])
    return spark.createDataFrame([(n,)], "refused long")


_CASES = [(k, c) for k in (2, 5, 8, 12, 20, 60) for c in ("p_brand, p_type", "p_brand, p_type, p_size", "p_size")]


@_query(
    " UNION ALL ".join(
        f"SELECT {k} AS k, '{c}' AS columns, CASE WHEN lost = n THEN 'empty' WHEN lost / n > 0.5 THEN 'hard' WHEN lost / n > 0.1 THEN 'soft' ELSE 'released' END AS outcome FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(coalesce(sum(n) FILTER (n < {k}), 0) AS DOUBLE) AS lost FROM (SELECT count(*) AS n FROM part GROUP BY {c}))"
        for k, c in _CASES
    )
)
def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guardrails say of releases of part with several k and quasi-identifiers."""
    df, s, rows = _t(spark, sf_dir, "part"), Settings(), []
    for k, columns in _CASES:
        found = enforce(df, columns.split(", "), k)
        try:
            engine.guard(found, s.soft_cap, s.hard_cap, False)
            outcome = "released"
        except RiskError as e:
            outcome = "empty" if "no rows" in str(e) else "hard" if "hard cap" in str(e) else "soft"
        found.done()
        rows.append((k, columns, outcome))
    return spark.createDataFrame(rows, "k int, columns string, outcome string")


@_query("SELECT count(*) AS rows_total, 0 AS rows_suppressed, count(*) AS k_achieved, 0 AS classes_total, true AS warned FROM lineitem")
def no_quasi_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without quasi-identifiers all rows stay, and a warning says what is not enforced."""
    out = enforce(_t(spark, sf_dir, "lineitem"), [], 5, ["l_tax"], 3)
    return spark.createDataFrame([(out.df.count(), out.rows_suppressed, out.k_achieved, out.classes_total, bool(out.warnings))], "rows_total long, rows_suppressed int, k_achieved long, classes_total int, warned boolean")


@_query("SELECT p_size AS size, p_brand AS q0, p_type AS row, p_name AS d0 FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_type) >= 12 AND p_brand IS NOT NULL")
def helper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that have the names of helpers stay as they are."""
    df = _t(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.col("p_brand").alias("q0"), F.col("p_type").alias("row"), F.col("p_name").alias("d0"))
    return enforce(df, ["q0", "row"], 12).df


_DIVERSE = "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS a, count(DISTINCT p_size) AS b FROM part GROUP BY p_brand"


@_query(f"SELECT p.p_brand, p.p_type, p.p_size FROM part p JOIN ({_DIVERSE}) c USING (p_brand) WHERE n >= 5 AND a >= 5 AND b >= 20")
def release_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns in clear text are sensitive by themselves: types and sizes, but not hidden names and keys."""
    ps = (Policy("p_brand", is_quasi_identifier=True), Policy("p_name", "hash"), Policy("p_name", "drop"), Policy("p_partkey", "drop"), Policy("p_retailprice", "drop"), Policy("p_brand", is_quasi_identifier=True))
    df = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name", "p_retailprice")
    out = engine.fold(df, ps, PUBLIC_KEY)
    qis = engine.quasi_identifiers(out, ps)
    first = enforce(out, qis, 5, ["p_type"], 5).df
    return enforce(first, qis, 5, [c for c in sensitive_columns(first, ps, qis, None) if c != "p_type"], 20).df


_COMPARED = _bin_sql("p_size", "5")


@_query(
    f"""WITH kept AS (SELECT p_brand, {_COMPARED} AS p_size, p_retailprice, p_type FROM part QUALIFY count(*) OVER (PARTITION BY p_brand) >= 8)
 SELECT 'p_brand' AS name, 'categorical' AS kind, CAST(NULL AS VARCHAR) AS after_kind, false AS dropped, count(DISTINCT p_brand) AS n_unique, CAST(NULL AS DOUBLE) AS mean FROM kept
 UNION ALL SELECT 'p_size', 'numeric', 'categorical', false, count(DISTINCT p_size), NULL FROM kept UNION ALL SELECT 'p_retailprice', 'numeric', NULL, false, NULL, round(avg(p_retailprice), 6) FROM kept
 UNION ALL SELECT 'p_type', 'categorical', NULL, false, count(DISTINCT p_type), NULL FROM kept UNION ALL SELECT 'p_name', 'categorical', NULL, true, NULL, NULL"""
)
def compare_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of columns before and after: kinds, dropped ones, numbers that became text."""
    df = _t(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice", "p_type", "p_name")
    ps = (Policy("p_brand", is_quasi_identifier=True), Policy("p_size", "numeric_bin", {"bin_width": 5}), Policy("p_name", "drop"))
    out = enforce(engine.fold(df, ps, PUBLIC_KEY), ["p_brand"], 8).df
    found = engine.compare(out, schema_profile(df))["columns"]
    rows = [(c, v["kind"], v.get("after_kind"), bool(v.get("dropped")), v.get("n_unique"), round(v["mean"], 6) if v.get("mean") is not None else None) for c, v in found.items()]
    return spark.createDataFrame(rows, "name string, kind string, after_kind string, dropped boolean, n_unique long, mean double")


_NUMERIC = ("l_quantity", "l_discount", "l_tax")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 6) AS mean_before, round(avg({c}) FILTER (l_returnflag = 'R'), 6) AS mean_after, round(corr(l_quantity, {c}), 6) AS with_quantity, round(corr(l_quantity, {c}) FILTER (l_returnflag = 'R'), 6) AS with_quantity_after, count(*) AS rows_before, count(*) FILTER (l_returnflag = 'R') AS rows_after FROM lineitem" for c in _NUMERIC))
def validation_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and correlations of two tables side by side."""
    df = _t(spark, sf_dir, "lineitem")
    found = engine.validation(df.select(*_NUMERIC), df.where("l_returnflag = 'R'").select(*_NUMERIC))
    r = lambda x: round(x, 6)
    pairs = [{b: r(v) for a, b, v in found[f"correlation_{side}"] if a == "l_quantity"} for side in ("before", "after")]
    rows = [(c, r(v["before"]["mean"]), r(v["after"]["mean"]), pairs[0][c], pairs[1][c], found["rows_before"], found["rows_after"]) for c, v in found["columns"].items()]
    return spark.createDataFrame(rows, "name string, mean_before double, mean_after double, with_quantity double, with_quantity_after double, rows_before long, rows_after long")


_LISTED = ("p_brand", "p_type", "p_size", "p_name")


@_query("SELECT CAST(row_number() OVER (ORDER BY n DESC, nr) AS INTEGER) AS place, name, n FROM (" + " UNION ALL ".join(f"SELECT {k} AS nr, '{c}' AS name, count(DISTINCT {c}) AS n FROM part" for k, c in enumerate(_LISTED)) + ")")
def qi_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quasi-identifiers with their distinct values, most first."""
    found = cardinalities(_t(spark, sf_dir, "part"), list(_LISTED))
    return spark.createDataFrame([(k + 1, c, n) for k, (c, n) in enumerate(found)], "place int, name string, n long")


@_query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) / 100.0 AS cost FROM customer GROUP BY ALL), m AS (SELECT c_mktsegment, max(cost) AS cost FROM c GROUP BY 1), n AS (SELECT c_mktsegment, count(*) AS n FROM c GROUP BY 1) SELECT c_mktsegment AS segment, CAST(least(n, floor((1.0 + 1e-9) / cost)) AS BIGINT) AS granted, CAST(n - least(n, floor((1.0 + 1e-9) / cost)) AS BIGINT) AS refused FROM m JOIN n USING (c_mktsegment)")
def ledger_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of each nation in a segment, at the cost of the segment's largest nation, until a budget of 1 is used up; two ledgers take turns on one log."""
    rows = _t(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").count().groupBy("c_mktsegment").agg((F.max("count") / 100.0).alias("cost"), F.count(F.lit(1)).alias("n")).collect()
    path = f"{shared_folder(spark)}/veilframe-queries/{hashlib.sha256(_folder(spark).encode()).hexdigest()}"
    one, two = Ledger(1.0, path=path), Ledger(1.0, path=path)
    out = []
    for r in sorted(rows):
        granted = 0
        for k in range(r.n):
            try:
                ledger = (one, two)[k % 2]
                token = ledger.reserve({r.c_mktsegment: r.cost})
                ledger.settle(token)
                granted += 1
            except BudgetError:
                continue
        out.append((r.c_mktsegment, granted, r.n - granted))
    return spark.createDataFrame(out, "segment string, granted long, refused long")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) + 0.0 AS lower, CAST(max({c}) AS DOUBLE) AS upper, true AS from_data, round(CASE WHEN max({c}) > min({c}) THEN (max({c}) - min({c})) / 10 ELSE 1 END, 9) AS bin_width FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")))
def noise_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of noise and widths of bins that are suggested for number columns, from their ranges."""
    rules = {"defaults": {"by_kind": {"numeric": {"action": "dp_laplace"}}}}
    rows = []
    for e in schema_profile(_t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")):
        s = suggest(e, "none", 5, rules)
        rows.append((e["name"], float(s["dp_params"]["lower"]), float(s["dp_params"]["upper"]), s["bounds_from_data"], round(float(offered_params("numeric_bin", None, e["min"], e["max"])["bin_width"]), 9)))
    return spark.createDataFrame(rows, "name string, lower double, upper double, from_data boolean, bin_width double")


@_query("SELECT c_custkey AS key, left(c_name, 2) || repeat('*', CAST(length(c_name) - 2 AS INTEGER)) AS name, CAST(c_acctbal AS DOUBLE) AS balance FROM customer ORDER BY c_custkey LIMIT 5")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five customers as a preview shows them: masked names, and balances in six digits."""
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy("c_custkey")
    found = engine.preview(df, Request((Policy("c_name", "mask", {"keep_prefix": 2}),)), Settings(), PUBLIC_KEY)
    return spark.createDataFrame([(int(r["c_custkey"]), r["c_name"], float(r["c_acctbal"])) for r in found], "key long, name string, balance double")


@_query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS VARCHAR) AS price, CASE WHEN l_tax > 0.04 THEN 'True' ELSE 'False' END AS taxed, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped FROM lineitem")
def python_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as text before they are hashed or masked: floats, booleans and times as Python writes them."""
    df = _t(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", text(F.col("l_extendedprice"), T.DoubleType()).alias("price"), text(F.col("l_tax") > 0.04, T.BooleanType()).alias("taxed"), text(F.col("l_shipdate"), T.TimestampNTZType()).alias("shipped"))


_NAMED = derived_key(replace(Settings(), salt=b"veilframe public test salt, 32 b", salt_is_lasting=True), "customers", ())


@_query(f"SELECT c_custkey, {_hmac_sql('c_name', 16, _NAMED)} AS hashed FROM customer")
def named_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes under a key that recurs for a name."""
    settings = replace(_LOOSE, salt=b"veilframe public test salt, 32 b", salt_is_lasting=True)
    request = Request((Policy("c_name", "hash"),), k=2, key_name="customers")
    return engine.release(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), request, settings, public=True).df.withColumnRenamed("c_name", "hashed")


@_query("SELECT least(1000, count(*)) AS sampled, count(*) AS small, 0 AS none FROM lineitem".replace("count(*) AS small", "(SELECT count(*) FROM supplier) AS small"))
def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows detection reads: so many at most, all of a table that is no larger, none if none are wanted; twice the same ones."""
    df, small = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "supplier")
    one, two = detection_sample(df, 1000), detection_sample(df.repartition(3), 1000)
    n = one.intersectAll(two).count()
    return spark.createDataFrame([(n, detection_sample(small, max(10_000, small.count())).count(), detection_sample(df, 0).count())], "sampled long, small long, none int")


_MAILS = "CASE WHEN c_custkey % 6 > 0 THEN 'u' || c_custkey || '@site.example' WHEN c_custkey % 12 = 0 THEN 'none' END"
_CARDS = "'411111111111' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"


@_query(
    f"""WITH d AS (SELECT {_MAILS} AS contact, c_mktsegment || c_custkey AS note, CAST(c_custkey AS VARCHAR) || '-x' AS order_id FROM customer), s AS (SELECT avg(CAST(regexp_matches(contact, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') AS INTEGER)) AS email FROM d)
 SELECT 'contact' AS name, CASE WHEN email >= 0.8 THEN 'email' ELSE 'none' END AS kind, round(CASE WHEN email >= 0.8 THEN least(0.99, email) ELSE 1.0 END, 6) AS confidence FROM s
 UNION ALL SELECT 'note', CASE WHEN count(*) > 20 AND count(DISTINCT note) / count(*) > 0.95 THEN 'identifier' ELSE 'none' END, CASE WHEN count(*) > 20 AND count(DISTINCT note) / count(*) > 0.95 THEN 0.6 ELSE 1.0 END FROM d
 UNION ALL SELECT 'order_id', CASE WHEN count(DISTINCT order_id) / count(*) >= 0.95 THEN 'identifier' ELSE 'none' END, CASE WHEN count(*) > 20 AND count(DISTINCT order_id) / count(*) > 0.95 THEN 0.7 WHEN count(DISTINCT order_id) / count(*) >= 0.95 THEN 0.85 ELSE 1.0 END FROM d"""
)
def detect_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and confidences that follow from shares of values: some addresses are missing or none."""
    key = F.col("c_custkey")
    mail = F.when(key % 6 > 0, F.concat(F.lit("u"), key, F.lit("@site.example"))).when(key % 12 == 0, "none")
    df = _t(spark, sf_dir, "customer").select(mail.alias("contact"), F.concat("c_mktsegment", key).alias("note"), F.concat(key, F.lit("-x")).alias("order_id"))
    return spark.createDataFrame([(c, s[0].kind, round(s[0].confidence, 6)) for c, s in detect(df).items()], "name string, kind string, confidence double")


@_query(f"SELECT 'contact' AS name, count(DISTINCT {_MAILS}) + 1 AS n_unique, count(*) FILTER (({_MAILS}) IS NULL) AS null_count, count(*) AS row_count, round(count(*) FILTER (contains({_MAILS}, '@')) / count({_MAILS}), 9) AS share FROM customer UNION ALL SELECT 'balance', count(DISTINCT c_acctbal), 0, count(*), NULL FROM customer UNION ALL SELECT 'part', count(DISTINCT c_nationkey), 0, count(*), NULL FROM customer")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values, nulls and matching shares of columns in one shuffle."""
    key = F.col("c_custkey")
    mail = F.when(key % 6 > 0, F.concat(F.lit("u"), key, F.lit("@site.example"))).when(key % 12 == 0, "none")
    df = _t(spark, sf_dir, "customer").select(mail.alias("contact"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("part"))
    found = counted(df, df.columns, True, lambda c, kind: {"email": is_email(c)} if isinstance(kind, T.StringType) else {}, ("email",))
    return spark.createDataFrame([(c, n.distinct, n.nulls, n.rows, round(n.shares["email"], 9) if n.shares else None) for c, n in found.items()], "name string, n_unique long, null_count long, row_count long, share double")


@_query("SELECT 'p_brand' AS name, (SELECT CASE WHEN count(DISTINCT p_brand) <= 100 AND count(DISTINCT p_brand) / count(*) <= 0.05 THEN 'categorical' ELSE 'string' END FROM part) AS kind, false AS told, CAST(count(*) FILTER (n < 8) AS BIGINT) AS suppressed, CAST(max(CASE WHEN sizes = 1 AND n >= 8 THEN 1 ELSE 0 END) AS INTEGER) AS warned, round(1.0 / greatest(1, min(n) FILTER (n >= 8)), 6) AS risk FROM (SELECT count(*) OVER (PARTITION BY p_brand) AS n, (SELECT count(DISTINCT p_size) FROM part q WHERE q.p_brand = part.p_brand) AS sizes FROM part)")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON and Markdown files of a release say, and what they leave out."""
    ps = (Policy("p_brand", is_quasi_identifier=True),)
    found = engine.release(_t(spark, sf_dir, "part").select("p_brand", "p_size"), Request(ps, k=8), _LOOSE, PUBLIC_KEY)
    folder = _folder(spark)
    paths = write_release(found, folder, "part")
    said = json.loads("\n".join(r.value for r in spark.read.text(paths[1], wholetext=True).collect()))
    shown = spark.read.text(paths[2], wholetext=True).first().value
    assert shown == to_markdown(found.report) and json.loads(to_json(found.report)) == said
    entry, k = said["schema"][0], said["k_anonymity"]
    told = any(x in json.dumps(said) for x in ("distinct_before", "correlation_before", "null_count"))
    return spark.createDataFrame([(entry["name"], entry["kind"], told, k["rows_suppressed"], int(bool(said["warnings"])), round(1 / max(1, k["k_achieved"]), 6))], "name string, kind string, told boolean, suppressed long, warned int, risk double")


@_query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through one CSV file that many tasks write."""
    df = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    back = read_table(spark, write_csv(df.repartition(5, "p_partkey"), f"{_folder(spark)}/part.csv"))
    return back.withColumn("p_size", F.col("p_size").cast("int"))
